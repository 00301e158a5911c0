"""Arrow UDFs for what needs the rules; everything else about boards is built from string functions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.board import claims, facts
from sievework.board.rules import Position


STRINGS = T.ArrayType(T.StringType())
#: Judgements that a worker remembers at most: many rows speak of few boards, or several columns of the same texts.
REMEMBERED = 1 << 14
#: Code points of a text that is remembered at most, which bounds a worker's memory.
LONG = 2048


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@lru_cache(REMEMBERED)
def _position(fen) -> Position | None:
    try:
        return Position.of(fen)
    except (ValueError, AttributeError, TypeError):
        return None


@lru_cache(REMEMBERED)
def _legal(fen, uci, san) -> tuple[bool, str | None]:
    p = _position(fen)
    move = p.parse(uci, san) if p else None
    return move is not None, move.uci if move else None


@F.pandas_udf(_struct(legal=T.BooleanType(), uci=T.StringType()))
def move_is_legal(fen: pd.Series, uci: pd.Series, san: pd.Series) -> pd.DataFrame:
    """(legal, uci) of a move given as uci or, failing that, in short notation."""
    return pd.DataFrame([_legal(f, u, s) for f, u, s in zip(fen, uci, san)], columns=["legal", "uci"])


@F.pandas_udf(STRINGS)
def hanging_squares(fen: pd.Series) -> pd.Series:
    from sievework.board.rules import name_of

    return fen.map(lambda f: [name_of(s) for w in (True, False) for s, _ in facts.all_hanging(p, w)] if (p := _position(f)) else None)


@F.pandas_udf(_struct(san=T.StringType(), piece=T.StringType(), is_capture=T.BooleanType(), captured=T.StringType(), is_check=T.BooleanType(), castle=T.StringType(), promotion=T.StringType(), develops=T.BooleanType(), attacks=STRINGS, defends=STRINGS))
def move_facts(fen: pd.Series, uci: pd.Series) -> pd.DataFrame:
    names = ["san", "piece", "is_capture", "captured", "is_check", "castle", "promotion", "develops", "attacks", "defends"]
    out = []
    for f, u in zip(fen, uci):
        p = _position(f)
        move = p.parse_uci(u) if p else None
        if move is None:
            out.append([None] * len(names))
            continue
        d = facts.move_facts(p, move)
        out.append([[f"{n} {s}" for s, n in d[k]] if k in ("attacks", "defends") else d[k] for k in names])
    return pd.DataFrame(out, columns=names)


@F.pandas_udf(T.StringType())
def fact_sheet(fen: pd.Series, ucis: pd.Series) -> pd.Series:
    return pd.Series([facts.fact_sheet(f, list(u) if u is not None else []) for f, u in zip(fen, ucis)])


@F.pandas_udf(_struct(tags=STRINGS, primary=T.StringType()))
def motif_tags(fen: pd.Series, ucis: pd.Series) -> pd.DataFrame:
    out = [facts.tags(p, list(u) if u is not None else []) if (p := _position(f)) else (None, None) for f, u in zip(fen, ucis)]
    return pd.DataFrame(out, columns=["tags", "primary"])


@F.pandas_udf(T.StringType())
def solver_position(fen: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([facts.solver_position(f, m) for f, m in zip(fen, line)])


@F.pandas_udf(T.StringType())
def plain_coaching(fen: pd.Series, uci: pd.Series) -> pd.Series:
    return pd.Series([facts.plain_coaching(f, u) for f, u in zip(fen, uci)])


@lru_cache(REMEMBERED)
def _verified(text, fen, uci, extended: bool) -> tuple[str | None, tuple[dict[str, str], ...]]:
    clean, bad = claims.verify(text, fen, uci, extended)
    return clean, tuple({"sentence": s, "reason": r} for s, r in bad)


def _verifier(extended: bool):
    @F.pandas_udf(_struct(clean=T.StringType(), violations=T.ArrayType(_struct(sentence=T.StringType(), reason=T.StringType()))))
    def verify(text: pd.Series, fen: pd.Series, uci: pd.Series) -> pd.DataFrame:
        out = [(_verified if len(t or "") <= LONG else _verified.__wrapped__)(t, f, u, extended) for t, f, u in zip(text, fen, uci)]
        return pd.DataFrame(out, columns=["clean", "violations"])

    return verify


verify_text, verify_text_extended = _verifier(False), _verifier(True)


@F.pandas_udf(_struct(uci=T.StringType(), how=T.StringType()))
def recommendation(text: pd.Series, fen: pd.Series, student: pd.Series, pool: pd.Series) -> pd.DataFrame:
    out = [claims.recommendation(t or "", f, s, list(u) if u is not None else None) if _position(f) else (None, "none") for t, f, s, u in zip(text, fen, student, pool)]
    return pd.DataFrame(out, columns=["uci", "how"])


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    import json

    return text.map(lambda t: None if (d := claims.first_object(t)) is None else json.dumps(d, sort_keys=True))


@F.pandas_udf(_struct(value=T.StringType(), status=T.IntegerType(), reason=T.StringType()))
def validated_position(raw: pd.Series) -> pd.DataFrame:
    """400 for blank, 422 for a wrong number of fields, an impossible board or a finished game, 200 otherwise."""
    out = []
    for text in raw:
        t = (text or "").strip()
        p = _position(t)
        if not t:
            out.append((None, 400, "blank"))
        elif len(t.split()) != 6:
            out.append((None, 422, "fields"))
        elif p is None or p.in_check(not p.white):
            out.append((None, 422, "impossible"))
        elif p.over():
            out.append((None, 422, "over"))
        else:
            out.append((t, 200, None))
    return pd.DataFrame(out, columns=["value", "status", "reason"])
