"""SQL spelling of constants.

Rule tables become one SQL expression each: a single parse instead of one call
into the JVM per table entry.
"""

from collections.abc import Iterable, Mapping


def text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def text_array(values: Iterable[str]) -> str:
    return f"CAST(array({text_list(values)}) AS ARRAY<STRING>)"


def text_map(table: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in table.items()) + ")"
