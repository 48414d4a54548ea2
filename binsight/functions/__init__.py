"""Column expressions (all JVM-side, codegen-friendly built-ins)."""

from binsight.functions.columns import (  # noqa: F401
    basename, capture_name, hour_of_day, indexed_name, iso_text, parse_time,
    percent_text, recode, base64_text, request_document, total_label, last_dotted,
)
from binsight.functions.random import (  # noqa: F401
    uniform, uniform_int, uniform_choice, weighted_choice, cumulative_bounds,
)
