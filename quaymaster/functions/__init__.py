"""Column functions: built-in expressions only, no Python UDF."""

from quaymaster.functions.numbers import (
    check_range, clean_boolean, clean_integer, clean_number, extract_number, matching,
    round_half_up, strip_currency, to_boolean, to_integer, to_number,
)
from quaymaster.functions.structured import (
    castable, check_hex_color, check_url, clean_array, clean_json, clean_uuid,
    is_json, is_json_container, to_json, to_uuid,
)
from quaymaster.functions.temporal import (
    clean_date, clean_timestamp, epoch_to_timestamp, is_date_like, iso_text,
    normalize_date_format, timestamp_or_epoch, to_date, to_timestamp,
)
from quaymaster.functions.text import (
    clean_phone, clean_text, is_empty_like, is_nullish, js_trim, normalize_enum,
    null_if_variant, resplit_list, strip_leading_zeros, strip_unit_suffix, to_text,
    truncate_to, uniqueness_key, value_kind,
)

__all__ = [n for n in dir() if not n.startswith("_")]
