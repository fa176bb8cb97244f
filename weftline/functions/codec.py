"""Codecs of protocols with branches, repeated groups and sequences.

A protocol is a list of nodes: ("field", label, bits), ("branch", label,
control labels, values, nodes), ("group", label, repeats, control label or
None, nodes). A branch is read where each of its control fields has the value
at its place (the last one for further fields); a group as often as its
control field says, within 0 and its repeats. Fields are named by their path;
members of a group that repeats bear the number of the round.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.bits import _crc


def flat_fields(nodes: list, path: tuple[str, ...] = ()) -> list[tuple[str, str, int]]:
    """(name, label, bits) of all fields a protocol may have, groups unrolled (P10)."""
    out = []
    for node in nodes:
        if node[0] == "field":
            out.append(("_".join((*path, node[1])), node[1], node[2]))
        elif node[0] == "branch":
            out += flat_fields(node[4], (*path, node[1]))
        else:
            for i in range(node[2]):
                out += flat_fields(node[4], (*path, f"{node[1]}_{i + 1}" if node[2] > 1 else node[1]))
    return out


def _walk(nodes: list, labels: dict[str, str], values: dict[str, int], visit: Callable[[str, int], bool], path: tuple[str, ...] = ()) -> bool:
    """Visits the fields that the values so far call for, in order, until visit says no."""
    for node in nodes:
        if node[0] == "field":
            if node[2] and not visit("_".join((*path, node[1])), node[2]):
                return False
        elif node[0] == "branch":
            wanted = [int(x) for x in node[3]]
            known = [c for c in node[2] if c in labels]
            holds = not wanted or all(values.get(labels[c], 0) == wanted[min(node[2].index(c), len(wanted) - 1)] for c in known)
            if holds and not _walk(node[4], labels, values, visit, (*path, node[1])):
                return False
        else:
            times = node[2] if node[3] not in labels else max(0, min(node[2], values.get(labels[node[3]], 0)))
            for i in range(times):
                if not _walk(node[4], labels, values, visit, (*path, f"{node[1]}_{i + 1}" if node[2] > 1 else node[1])):
                    return False
    return True


def _labels(nodes: list) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, label, _ in flat_fields(nodes):
        out.setdefault(label, name)
    return out


def decoder(nodes: list, little: bool = False):
    """A pandas function: all fields of a payload (0 where not called for), and ``complete``, false for a truncated one."""
    names = [n for n, _, _ in flat_fields(nodes)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("complete", T.BooleanType())])
    labels = _labels(nodes)

    @F.pandas_udf(schema)
    def run(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for payload in payloads:
            bits, at, values = "".join(f"{b:08b}" for b in payload or b""), 0, {}

            def read(name: str, width: int) -> bool:
                nonlocal at
                if at + width > len(bits):
                    return False
                part = bits[at : at + width]
                values[name], at = int(part[::-1] if little else part, 2), at + width
                return True

            complete = _walk(nodes, labels, values, read)
            rows.append([values.get(n, 0) for n in names] + [complete])
        return pd.DataFrame(rows, columns=[*names, "complete"])

    return run


def encoder(nodes: list, packed: bool = True, little: bool = False):
    """A pandas function of a struct of the fields: the payload, bit-packed, or each append from a byte boundary on.

    Unpacked and little, every bit is an append of its own.
    """
    labels = _labels(nodes)

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            values = {k: int(v) for k, v in row.items() if v is not None and v == v}
            bits = ""

            def write(name: str, width: int) -> bool:
                nonlocal bits
                own = format(values.get(name, 0) & ((1 << width) - 1), f"0{width}b")
                for part in own[::-1] if little else [own]:
                    bits += part
                    if not packed:
                        bits += "0" * (-len(bits) % 8)
                return True

            _walk(nodes, labels, values, write)
            bits += "0" * (-len(bits) % 8)
            out.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        return pd.Series(out)

    return run


def member_condition(controls: list[str], values: list[str], fields: dict[str, Column]) -> Column:
    """All of a sequence member's control fields have their values; without controls it holds."""
    tests = [fields[c] == F.lit(int(values[min(i, len(values) - 1)]) if values else 0) for i, c in enumerate(controls) if c in fields]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def sequence_of(sequences: list[tuple[str, list[tuple[list[str], list[str]]]]], fields: dict[str, Column], default: str = "Seq_1") -> Column:
    """The first sequence all of whose members' conditions hold (M30); the default where there are none."""
    if not sequences:
        return F.lit(default)
    out = None
    for name, members in sequences:
        holds = F.lit(True)
        for controls, values in members:
            holds = holds & member_condition(controls, values, fields)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def verified(rules: list[dict], fields: dict[str, Column]) -> Column:
    """(tag, action, code) of the first rule whose field has none of its values, else ok.

    A rule: field, values, tag, action, code.
    """
    result = lambda tag, action, code: F.struct(F.lit(tag).alias("tag"), F.lit(action).alias("action"), F.lit(code).alias("code"))
    out = None
    for r in rules:
        breaks = ~F.coalesce(fields[r["field"]].isin(*r["values"]), F.lit(False))
        out = F.when(breaks, result(r["tag"], r["action"], r["code"])) if out is None else out.when(breaks, result(r["tag"], r["action"], r["code"]))
    ok = result("", "accept", 0)
    return ok if out is None else out.otherwise(ok)


@F.pandas_udf(T.StringType())
def field_crcs(values: pd.Series) -> pd.Series:
    """CRC-16 of the text of the fields bound to a message rule, joined by commas."""
    return values.map(lambda own: None if own is None else _crc(",".join(str(x) for x in own)))
