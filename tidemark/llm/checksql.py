"""SQL fragments for DuckDB that several queries' SQL shares."""

from __future__ import annotations

#: A table ``crc_table(entries)``: the 256 entries of the CRC-32 table, by the polynomial's own steps.
CRC_TABLE = """
    crc_steps(i, k, c) as (
        select i, 0, i::bigint from range(256) t(i)
        union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from crc_steps where k < 8
    ), crc_table as (select list(c order by i) as entries from crc_steps where k = 8)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text; ``entries`` of ``crc_table`` must be in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c // 256, entries[(xor(c, b) % 256) + 1])), 4294967295)"
