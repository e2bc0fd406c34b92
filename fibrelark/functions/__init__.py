"""Column functions of the engine."""

from fibrelark.functions.columns import (  # noqa: F401
    coefficient_of_variation,
    count_or_null,
    day_phase,
    entropy,
    fec_probabilities,
    finite,
    lag_one,
    milliwatt_to_dbm,
    ratio_or_null,
)
