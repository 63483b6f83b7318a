"""Masking of personal data, as expressions that stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# What is masked and how, applied in this order.
_LEFT, _RIGHT, _DIGIT = r"(?<!\p{Nd})", r"(?!\p{Nd})", r"\p{Nd}"
_USER = "[A-Za-z0-9._%+-]"
MASKS: tuple[tuple[str, str], ...] = (
    # mobile phone: first 3 and last 4 stay
    (rf"{_LEFT}(1[3-9]{_DIGIT}){_DIGIT}{{4}}({_DIGIT}{{4}}){_RIGHT}", "$1****$2"),
    # identity card: first 6 and last 4 stay
    (rf"{_LEFT}({_DIGIT}{{6}}){_DIGIT}{{8}}({_DIGIT}{{3}}[{_DIGIT}Xx]){_RIGHT}", "$1********$2"),
    # bank card of 16 to 19 digits: first 4 and last 4 stay
    (rf"{_LEFT}({_DIGIT}{{4}}){_DIGIT}{{8,11}}({_DIGIT}{{4}}){_RIGHT}", "$1****$2"),
    # e-mail: first 2 characters of the user stay when it has more than 2
    (rf"(?:({_USER}{{2}}){_USER}+|{_USER}{{1,2}})@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})", "$1***@$2"),
)


def redact_email(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("@")), F.regexp_replace(col, *MASKS[3])).otherwise(col)


def _mask(col: Column) -> Column:
    """All masks; texts without a long digit run or an ``@`` skip the patterns that need one."""
    digits = col
    for pattern, replacement in MASKS[:3]:
        digits = F.regexp_replace(digits, pattern, replacement)
    numbers = F.when(col.rlike(rf"{_DIGIT}{{11}}"), digits).otherwise(col)
    return F.when(F.contains(col, F.lit("@")), F.regexp_replace(numbers, *MASKS[3])).otherwise(numbers)


def redact_text(col: Column, whitelist: Sequence[str] = ()) -> Column:
    """Mask phone, identity card, bank card and e-mail; listed phrases stay as they are."""
    if not whitelist:
        return _mask(col)
    listed = "|".join(r"\Q" + item + r"\E" for item in sorted(whitelist, key=len, reverse=True) if item)
    kept = F.regexp_extract_all(col, F.lit(listed), F.lit(0))
    gaps = F.transform(F.split(col, listed), _mask)
    pieces = F.zip_with(gaps, kept, lambda gap, keep: F.concat(gap, F.coalesce(keep, F.lit(""))))
    return F.array_join(pieces, "")


def redact_struct(col: Column, dtype: T.DataType, whitelist: Sequence[str] = ()) -> Column:
    """Mask every string leaf of a nested value; field names and map keys stay."""
    if isinstance(dtype, T.StringType):
        return redact_text(col, whitelist)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda item: redact_struct(item, dtype.elementType, whitelist))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _key, value: redact_struct(value, dtype.valueType, whitelist))
    if isinstance(dtype, T.StructType):
        fields = [redact_struct(col[f.name], f.dataType, whitelist).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col
