"""Gate stacks over teacher candidates: which reasons speak against a row, and the target that it renders.

A candidate has tier, fen, rec_uci, rec_san, coaching, method, takeaway, concepts (array), sound_ucis (array) and, where a
gate asks for it, canonical_uci and wide. Reasons stand in a fixed order. Null fields count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.board import columns as C
from sievework.functions import text as T
from sievework.functions.buckets import LEVELS
from sievework.operators.gates import with_reasons

# ---- fixed values: plies that a text may narrate, by level; without a level the largest holds ----
PLY_CAPS = {"beginner": 2, "intermediate": 4, "advanced": 6}
# ---- end of fixed values ----
FIELDS = ("tier", "fen", "rec_uci", "rec_san", "coaching", "method", "takeaway")


def filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def tidy(rows: DataFrame) -> DataFrame:
    """The rows with every field trimmed and null ones empty."""
    return rows.withColumns({name: filled(name) for name in FIELDS})


def _has(name: str) -> Column:
    return F.col(name) != ""


def _cap() -> Column:
    known = F.create_map(*[F.lit(x) for kv in PLY_CAPS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.col("tier")), F.lit(max(PLY_CAPS.values())))


def _sound() -> Column:
    pool = F.transform(F.coalesce("sound_ucis", F.array().cast("array<string>")), lambda u: F.lower(u))
    return _has("rec_uci") & F.array_contains(pool, F.lower("rec_uci"))


def _legal() -> Column:
    """Null where there is nothing to judge."""
    judged = C.move_is_legal("fen", F.nullif("rec_uci", F.lit("")), F.nullif("rec_san", F.lit("")))["legal"]
    return F.when(_has("fen") & (_has("rec_uci") | _has("rec_san")), judged)


def _false_sentences(text: Column) -> Column:
    return F.when(_has("fen") & (text != ""), F.size(C.verify_text(text, F.col("fen"), F.lit(None).cast("string"))["violations"])).otherwise(0)


def bank_gate(rows: DataFrame, faithfulness: str = "off", with_method: bool = False, parsed: Column | None = None, renders: Column | None = None) -> DataFrame:
    """Adds reasons of the bank's gate; texts are those that the later tests saw (cleaned ones under "strip").

    faithfulness is off, reject (a false sentence is a reason) or strip (false sentences go before the other tests look).
    `parsed` is false for a line that was no JSON, `renders` for input that the prompt cannot be made of; duplicates
    among clean rows are for first_clean.
    """
    rows = tidy(rows).withColumn("legal", _legal())
    whole = F.concat_ws("\n", *[F.when(_has(c), F.col(c)) for c in ("coaching", "method", "takeaway")])
    rows = rows.withColumn("n_false", _false_sentences(whole) if faithfulness != "off" else F.lit(0))
    if faithfulness == "strip":
        clean = lambda c: F.when((F.col("n_false") > 0) & _has(c), F.trim(C.verify_text(F.col(c), F.col("fen"), F.lit(None).cast("string"))["clean"])).otherwise(F.col(c))
        rows = rows.withColumns({c: clean(c) for c in ("coaching", "method", "takeaway")})
    named = _has("rec_uci") | _has("rec_san")
    tests = [
        ("missing_tier", ~F.col("tier").isin(*LEVELS)),
        ("faithfulness", F.lit(faithfulness == "reject") & (F.col("n_false") > 0)),
        ("missing_recommendation", ~named),
        ("soundness", named & ~_sound()),
        ("engine_speak", F.size(T.leaks(F.concat_ws("\n", "coaching", "takeaway"))) > 0),
        ("ply_cap", T.longest_move_run(F.col("coaching")) > _cap()),
        ("missing_fen", ~_has("fen")),
        ("illegal_move", ~F.col("legal")),
        ("empty_coaching", ~_has("coaching")),
        ("empty_takeaway", ~_has("takeaway")),
        ("missing_method", F.lit(with_method) & ~_has("method")),
    ]
    out = with_reasons(rows, tests)
    if renders is not None:
        out = out.withColumn("reasons", F.when((F.size("reasons") == 0) & ~renders, F.array(F.lit("render_error"))).otherwise(F.col("reasons")))
    if parsed is not None:
        out = out.withColumn("reasons", F.when(parsed, F.col("reasons")).otherwise(F.array(F.lit("invalid_json"))))
    return out.drop("legal")


def _staged(rows: DataFrame, first: list[tuple[str, Column]], second: list[tuple[str, Column]]) -> DataFrame:
    """reasons: those of the first stage or, without any, of the second; null tests do not fail."""
    named = lambda tests: F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda r: r.isNotNull())
    rows = rows.withColumn("reasons", named(first))
    return rows.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(named(second)))


def _lead_and_label() -> list[tuple[str, Column]]:
    lead = F.concat(F.lit("I'd play "), F.col("rec_san"), F.lit("."))
    return [("format_lead", ~F.startswith("target", lead)), ("format_takeaway", ~F.contains("target", F.lit("Takeaway:")))]


def _leaky() -> tuple[str, Column]:
    return "engine_speak", F.size(T.leaks(F.col("target"))) > 0


def _clean_target(takeaway: Column) -> Column:
    """Lead cleaned, plain words for beginners, blanks squeezed."""
    made = T.rendered_target(F.col("rec_san"), T.clean_lead(F.col("coaching")), F.col("method"), takeaway)
    return F.regexp_replace(T.beginner_scrub(made, F.col("tier")), "  +", " ")


def curation_gate(rows: DataFrame, augment: bool = False) -> DataFrame:
    """Adds target, native, reasons and score of the curation gate: exactly the canonical move, every claim checked.

    Structure, move and legality come first; only rows without such reasons are rendered and read. A takeaway that names
    no principle gets a clause only with `augment`.
    """
    rows = tidy(rows).withColumn("legal", _legal()).withColumn("native", T.names_principle(F.col("takeaway")))
    spliced, _ = T.takeaway_with_principle(F.col("takeaway"), T.clean_lead(F.col("coaching")), F.col("concepts"), F.col("tier"))
    rows = rows.withColumn("target", _clean_target(F.when(F.lit(augment) & ~F.col("native"), spliced).otherwise(F.col("takeaway"))))
    own = F.get(F.split("target", "Takeaway:", 2), F.lit(1))
    first = [
        ("empty_coaching", ~_has("coaching")), ("missing_method", ~_has("method")), ("empty_takeaway", ~_has("takeaway")),
        ("missing_move", ~_has("rec_uci")), ("tier_move_mismatch", _has("rec_uci") & (F.lower("rec_uci") != F.lower("canonical_uci"))),
        ("soundness", _has("rec_uci") & ~_sound()), ("illegal_move", ~F.col("legal")),
    ]
    bad = T.bad_heuristic(F.col("target"))
    wide = F.size(C.verify_text_extended("target", "fen", F.nullif("rec_uci", F.lit("")))["violations"])
    second = [_leaky(), ("ply_cap", T.longest_move_run(F.col("target")) > _cap()), *_lead_and_label(), ("no_principle_in_takeaway", ~T.names_principle(F.coalesce(own, F.lit("")))), ("bad_heuristic", bad.isNotNull()), ("faithfulness_ext", wide > 0)]
    out = _staged(rows, first, second)
    out = out.withColumn("reasons", F.transform("reasons", lambda r: F.when(r == "bad_heuristic", F.concat(r, F.lit(":"), bad)).otherwise(r)))
    score = T.instructiveness(F.col("target"), F.col("coaching"), F.col("method"), F.col("takeaway"), F.col("concepts"), F.col("tier"), F.col("rec_san"))
    return out.withColumn("score", F.when(F.size("reasons") == 0, score)).drop("legal")


def grounded_gate(rows: DataFrame, augment: bool = True) -> DataFrame:
    """Adds target, augmented and reasons of the grounded sets' gate: structure first, then the rendered target, with the
    narrow check of claims. With `augment` the lead is cleaned and a takeaway without a principle gets one; without, the
    target keeps its words, only a command that repeats the move goes, and the narrated line is that of the texts."""
    rows = tidy(rows).withColumn("legal", _legal())
    if augment:
        takeaway, augmented = T.takeaway_with_principle(F.col("takeaway"), T.clean_lead(F.col("coaching")), F.col("concepts"), F.col("tier"))
        rows = rows.withColumn("target", _clean_target(takeaway)).withColumn("augmented", augmented)
        narrated = F.col("target")
    else:
        lead = F.concat(F.lit(r"(?i)^\s*(?:i['’]?d\s+play|let['’]?s\s+play|play|consider|go\s+with)\s+\Q"), F.col("rec_san"), F.lit(r"\E\b[\s.:,;!\-]*"))
        body = F.trim(F.regexp_replace(F.col("coaching"), lead, F.lit("")))
        how = F.when(_has("method"), F.concat(F.lit(" How to find it: "), F.col("method"))).otherwise("")
        made = F.concat(F.trim(F.concat(F.lit("I'd play "), F.col("rec_san"), F.lit(". "), body)), how, F.lit(" Takeaway: "), F.col("takeaway"))
        rows = rows.withColumn("target", F.trim(made)).withColumn("augmented", F.lit(False))
        narrated = F.concat_ws(" ", "coaching", "method")
    first = [
        ("missing_tier", ~F.col("tier").isin(*LEVELS)), ("missing_fen", ~_has("fen")), ("empty_coaching", ~_has("coaching")), ("missing_method", ~_has("method")),
        ("empty_takeaway", ~_has("takeaway")), ("soundness", ~_sound()), ("illegal_move", ~F.col("legal")),
    ]
    second = [_leaky(), ("ply_cap", T.longest_move_run(narrated) > _cap()), *_lead_and_label(), ("faithfulness_narrow", _false_sentences(F.col("target")) > 0)]
    return _staged(rows, first, second).drop("legal")


def target_gate(rows: DataFrame) -> DataFrame:
    """Adds passes: a finished target has its lead, its takeaway, no leak, a line within the cap, and no false sentence."""
    tests = [~F.col("legal_lead"), _leaky()[1], T.longest_move_run(F.col("target")) > _cap(), _false_sentences(F.col("target")) > 0]
    rows = rows.withColumn("fen", filled("fen")).withColumn("legal_lead", ~(_lead_and_label()[0][1] | _lead_and_label()[1][1]))
    failed = F.lit(False)
    for test in tests:
        failed = failed | F.coalesce(test, F.lit(False))
    return rows.withColumn("passes", ~failed).drop("legal_lead")
