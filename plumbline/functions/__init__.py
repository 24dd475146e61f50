from plumbline.functions.scalar import (  # noqa: F401
    blank_to_null,
    compact_key,
    is_text,
    normalised_key,
    safe_date,
    safe_double,
    text_of,
)
