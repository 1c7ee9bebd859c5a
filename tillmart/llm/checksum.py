"""CRC-32 in the SQL that queries are compared with, which has no such function."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit; null for null."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len({text}) + 1),
        lambda i: ascii(substr({text}, i, 1))::BIGINT)), lambda crc, byte: list_reduce(
        list_concat([xor(crc, byte)], list_transform(range(8), lambda z: 0::BIGINT)),
        lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
