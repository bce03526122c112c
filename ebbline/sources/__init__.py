"""Sources and sinks: files, staged uploads and the mart."""
