"""The domain's worked cases, and contracts of sampling and gates."""

from pyspark.sql import functions as F

from sievework.functions import buckets as B
from sievework.functions import structs as K
from sievework.functions import text as T
from sievework.operators import gates as G
from sievework.operators import mix as X
from sievework.operators import sampling as P
from sievework.operators import select as S
from sievework.operators import metrics as M


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_level_gradient(spark):
    rows = spark.createDataFrame([(1, 0, 40, .05), (1, 1, 20, .25), (1, 2, 10, .55)], "g long, idx long, cp long, p double")
    pick = lambda w: S.blended_pick(rows, "g", "cp", "p", "idx", w).first().idx
    assert (pick(0.0), pick(1.0)) == (0, 2)
    assert S.blended_pick(rows.withColumn("p", F.lit(None).cast("double")), "g", "cp", "p", "idx", 1.0).first().idx == 0


def test_second_rule_and_collapse(spark):
    pool = spark.createDataFrame([(1, 0, 90, .05, .04, .5, True), (1, 1, 80, .6, .2, .2, True), (1, 2, 10, .1, .1, .1, True)], "gid long, idx long, cp long, p_b double, p_i double, p_a double, agree boolean")
    r = S.triads(pool).first()
    assert (r.a, r.b, r.discriminating, r.pattern) == (0, 1, True, "B=I!=A")
    flat = spark.createDataFrame([(1, 0, 90, .9, .01, .5, True), (1, 1, 89, .01, .9, .2, True)], "gid long, idx long, cp long, p_b double, p_i double, p_a double, agree boolean")
    assert S.triads(flat).first().pattern == "B=I=A"


def test_board_text(spark):
    fen = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3"
    drawn = one(spark, d=B.drawing_of_board(F.lit(fen))).d
    assert drawn.split("\n")[0] == "r . b q k b n r" and drawn.split("\n")[3] == ". . . . p . . ."
    key = one(spark, k=B.position_key_of_drawing(F.lit(f"Board:\n{drawn}\nWhite to move.")), k2=B.position_key(F.lit(fen), 2), k4=B.position_key(F.lit(fen)), bad=B.position_key(F.lit("8/8 w")))
    assert key.k == key.k2 == fen.rsplit(" ", 4)[0] and key.k4 == fen.rsplit(" ", 2)[0] and key.bad is None
    end = "8/8/8/4k3/8/4K3/4P3/8 w - - 0 60"
    got = one(spark, a=B.phase_by_material(F.lit(fen)), b=B.phase_by_count(F.lit(fen)), c=B.phase_by_queens(F.lit(fen)), d=B.phase_by_queens(F.lit(end)), e=B.phase_by_count(F.lit(end)))
    assert tuple(got) == ("opening", "opening", "opening", "endgame", "endgame")
    assert one(spark, r=B.tablebase_result(F.lit("loss"))).r == "win"


def test_heuristics(spark):
    bad = ["Trade pieces when you are behind.", "When losing, simplify at once.", "Passed pawns must be pushed.", "Always castle early."]
    good = ["Trade when ahead.", "Castle when it is safe.", "Develop your knights first."]
    rows = spark.createDataFrame([(t,) for t in bad + good], "t string").select("t", T.bad_heuristic(F.col("t")).alias("h"), T.names_principle(F.col("t")).alias("p")).collect()
    assert [r.h is not None for r in rows] == [True] * 4 + [False] * 3 and rows[-1].p


def test_text_rules(spark):
    r = one(spark, run=T.longest_move_run(F.lit("Play 1. e4 e5 2. Nf3 then rest")), ev=T.longest_move_run_eval(F.lit("e4 e5 1-0 Nf3")), au=T.longest_move_run_audit(F.lit("1. e4 e5 2. Nf3")),
            leak=T.leaks(F.lit("about 150cp, +1.3 by Engine; top-3")), lead=T.clean_lead(F.lit("Play Nf3. And it develops.")), scrub=T.beginner_scrub(F.lit("gain a tempo and the initiative"), F.lit("beginner")),
            think=T.strip_thinking(F.lit("<think>x</think> a</think>b")), swap=T.swapped_token(F.lit("Nf3 or Nf3+ or aNf3, Nf3."), F.lit("Nf3"), F.lit("e4")), sents=T.sentences(F.lit("One. Two!\nThree")),
            rate=T.rating_of_title(F.lit("Climb 1200-1400")), rate2=T.rating_of_title(F.lit("Episode 12")), sec=T.section_of(F.lit("## Beginner tier\nabc\n\n## Other\nx"), "beginner"))
    assert (r.run, r.ev, r.au) == (3, 2, 2) and r.leak == ["150cp", "Engine", "+1.3", "+1"] and r.lead == "It develops." and r.scrub == "gain time and the attack"
    assert r.think == "b" and r.swap == "e4 or Nf3+ or aNf3, e4." and r.sents == ["One.", "Two!", "Three"] and r.rate == 1300 and r.rate2 is None and r.sec == "abc"


def test_takeaway_and_render(spark):
    t, a = T.takeaway_with_principle(F.lit("Be calm."), F.lit("You castled well"), F.array(F.lit("tempo")), F.lit("beginner"))
    t2, _ = T.takeaway_with_principle(F.lit(""), F.lit("nothing"), F.array(F.lit("weak squares")), F.lit("advanced"))
    t3, a3 = T.takeaway_with_principle(F.lit("Fight for the center."), F.lit(""), F.array().cast("array<string>"), F.lit("advanced"))
    r = one(spark, t=t, a=a, t2=t2, t3=t3, a3=a3, full=T.rendered_target(F.lit("e4"), F.lit("Good."), F.lit(None).cast("string"), F.lit("Go.")))
    assert r.t.startswith("King safety first") and r.a and r.t2 == "Target the weak pawn." and r.t3 == "Fight for the center." and not r.a3
    assert r.full == "I'd play e4. Good. Takeaway: Go."
    body, take = T.split_target(F.lit("Body. Takeaway: One line\nmore"))
    assert tuple(one(spark, b=body, t=take)) == ("Body.", "One line")
    score = T.instructiveness(F.lit("x " * 100), F.lit("on e4 and d5"), F.lit("Ask which piece"), F.lit("Fight for the center"), F.array(F.lit("a")), F.lit("beginner"), F.lit("Nf3"))
    assert one(spark, s=score).s == 2 + 3 + 2 + 1 + 1.5


def test_json_repairs(spark):
    r = one(spark, w=K.widest_json(F.lit('x {"a": {"b": 1}} y')), rank=K.repaired_ranking(F.array(F.lit("b"), F.lit("B"), F.lit("z")), F.array(F.lit("A"), F.lit("B"))), v=K.verdict(F.lit("?")), g=K.clamped_grade(F.lit("99")),
            names=K.renamed_keys(F.create_map(F.lit("A"), F.lit(1), F.lit("Z"), F.lit(2)), F.create_map(F.lit("A"), F.lit("m1"))), one=K.string_list(F.lit('[" a ", ""]')), fen=K.nested_strings(F.lit('{"teacher_input": {"fen": "f"}}')))
    assert r.w == '{"a": {"b": 1}}' and r.rank == ["B", "A"] and r.v.inconclusive and not r.v.truthful and r.g == 10.0 and r.names == {"m1": 1} and r.one == ["a"] and r.fen == ["f"]


def test_gate_and_dedup(spark):
    rows = spark.createDataFrame([(1, "k", True), (2, "k", False), (3, "k", False)], "seq long, key string, bad boolean")
    out = {r.seq: (r.reasons, r.kept) for r in G.first_clean(G.with_reasons(rows, [("bad", F.col("bad"))]), ["key"], ["seq"]).collect()}
    assert out == {1: (["bad"], False), 2: ([], True), 3: (["duplicate"], False)}


def test_quorum(spark):
    votes = spark.createDataFrame([(1, True, True), (1, False, True), (2, True, False), (2, True, False), (3, True, False)], "item long, truthful boolean, inconclusive boolean")
    got = {r.item: (r.truthful, r.inconclusive) for r in M.panel_verdict(votes, "item").collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, True)}


def test_splits_are_exact_and_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("g"))
    seen = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        valid = {r.k for r in P.ratio_split(rows.repartition(n), "k", 0.05).where("is_valid").collect()}
        groups = P.group_split(rows.repartition(n), "g", 0.1).groupBy("g").agg(F.countDistinct("is_valid").alias("n"), F.max("is_valid").alias("v")).collect()
        assert len(valid) == 50 and all(r.n == 1 for r in groups) and sum(r.v for r in groups) == 4
        seen.append(valid)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2]
    assert P.ratio_split(rows.limit(1), "k", 0.5).where("is_valid").count() == 0


def test_greedy_quota_matches_a_loop(spark):
    from sievework.operators.quotas import greedy_quota

    rows = spark.createDataFrame([(i, [t for t in ("a", "b", "c") if (i * 7 + ord(t)) % 3 == 0 or i % 5 == 0]) for i in range(200)], "k long, tags array<string>")
    quotas = {"a": 9, "b": 3, "c": 20}
    left, want = dict(quotas), []
    for r in sorted(rows.collect(), key=lambda r: r.k):
        t = next((t for t in [q for q in r.tags if q in quotas] if left[t] > 0), None)
        if t:
            left[t] -= 1
            want.append((r.k, t))
    assert sorted(tuple(r) for r in greedy_quota(rows, "tags", "k", quotas).collect()) == want


def test_preference_pairs(spark):
    rows = spark.createDataFrame([(1, "b", "e4", "I'd play e4."), (1, "a", "d4", "I'd play d4."), (2, "b", "c4", "no move")], "item long, level string, pick string, text string")
    got = sorted((r.level, r.chosen, r.rejected) for r in X.preference_pairs(rows, "item", "level", "pick", "text").collect())
    assert got == [("a", "I'd play d4.", "I'd play e4."), ("b", "I'd play e4.", "I'd play d4.")]


def test_top_per_group_keeps_few_rows_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"))
    plan = P.per_stratum(rows, ["g"], "k", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
