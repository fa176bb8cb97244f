"""Bit fields in binary payloads and their checksum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_bits(payload: Column, offset: int, width: int) -> Column:
    """A field of up to 56 bits, most significant bit first, in JVM expressions; NULL past the end."""
    first, last = offset // 8, (offset + width - 1) // 8
    word = F.conv(F.hex(F.substring(payload, first + 1, last - first + 1)), 16, 10).cast("decimal(20,0)")
    shifted = F.floor(word / F.lit(1 << ((last + 1) * 8 - offset - width))).cast("decimal(20,0)")
    return F.when(F.octet_length(payload) > last, (shifted % F.lit(1 << width)).cast("long"))


def decoder(fields: list[tuple[str, int]], little: bool = False):
    """A pandas function: the fields (name, width), one after the other, of a payload; a truncated one stops."""

    schema = T.StructType([T.StructField(name, T.LongType()) for name, _ in fields])

    @F.pandas_udf(schema)
    def run(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for payload in payloads:
            bits = np.unpackbits(np.frombuffer(payload or b"", np.uint8), bitorder="little" if little else "big")
            at, row = 0, []
            for _, width in fields:
                part = bits[at : at + width]
                order = part[::-1] if little else part
                row.append(int("".join(map(str, order)), 2) if len(part) == width and width else None)
                at += width
            rows.append(row)
        return pd.DataFrame(rows, columns=[n for n, _ in fields], dtype="Int64")

    return run


def encoder(widths: list[int], packed: bool = True, little: bool = False):
    """A pandas function of the fields' values: bit-packed, or each field from a byte boundary on."""

    @F.pandas_udf(T.BinaryType())
    def run(*values: pd.Series) -> pd.Series:
        out = []
        for row in zip(*values, strict=True):
            bits = ""
            for value, width in zip(row, widths, strict=True):
                own = format(int(value) & ((1 << width) - 1), f"0{width}b")
                bits += own[::-1] if little else own
                if not packed:
                    bits += "0" * (-len(bits) % 8)
            bits += "0" * (-len(bits) % 8)
            data = [bits[i : i + 8] for i in range(0, len(bits), 8)]
            out.append(bytes(int(b[::-1] if little else b, 2) for b in data))
        return pd.Series(out)

    return run


def _crc(text: str) -> str:
    crc = 0xFFFF
    for byte in text.encode():
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ 0xA001 if crc & 1 else crc >> 1
    return f"{crc:04X}"


@F.pandas_udf(T.StringType())
def crc16(values: pd.Series) -> pd.Series:
    """CRC-16 (initial FFFF, polynomial A001) of a value's text, four hex digits."""
    return pd.Series([None if v is None else _crc(str(v)) for v in values])
