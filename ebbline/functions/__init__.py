"""Column expressions: everything here is built from JVM-side functions."""

from ebbline.functions.buckets import lookup, risk_segment, tenure_bucket
from ebbline.functions.dates import utc_now, utc_today
from ebbline.functions.hashing import gaussian_noise, hash52
from ebbline.functions.numeric import clip, nan_to_null, round_even, to_number
from ebbline.functions.text import strip

__all__ = [
    "clip",
    "gaussian_noise",
    "hash52",
    "lookup",
    "nan_to_null",
    "risk_segment",
    "round_even",
    "strip",
    "tenure_bucket",
    "to_number",
    "utc_now",
    "utc_today",
]
