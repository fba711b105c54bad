"""Column-level helpers: every function returns a Catalyst ``Column``."""

from .scalars import (  # noqa: F401
    cents_to_dollars,
    cosine,
    is_blank,
    is_missing,
    is_null_token,
    kurtosis_unbiased,
    safe_divide,
    skewness_unbiased,
    surrogate_key,
    row_hash,
    trim_all,
)
from .quantiles import exact_quantiles, rank_quantiles  # noqa: F401
