import pytest
from pyspark.sql import functions as F

from sievework.board import claims, columns, facts
from sievework.board.rules import START, Position, perft

MIDDLE = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"
OPEN = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3"


@pytest.mark.parametrize("fen,depth,leaves", [(START, 3, 8902), (MIDDLE, 2, 2039), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3, 2812), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 2, 1486)])
def test_published_perft_counts(fen, depth, leaves):
    assert perft(Position.of(fen), depth) == leaves


def test_notation_round_trip():
    for fen in (START, MIDDLE, OPEN):
        p = Position.of(fen)
        legal = p.moves()
        assert p.fen == fen and all(p.parse_san(p.san(m, legal)) == m and p.parse_uci(m.uci) == m for m in legal)
    assert Position.of(OPEN).parse_san("Ke5") is None and Position.of(OPEN).parse("zz", "Nxe5").uci == "f3e5"


@pytest.mark.parametrize("text,ok", [
    ("The knight on f3 is active.", True), ("The knight on f4 is active.", False), ("The e5 pawn is weak.", True), ("Your queen waits.", True), ("White to move here.", True), ("It is black's turn to move nowhere.", True),
    ("White can castle kingside.", True), ("The knight on f3 attacks the pawn on e5.", True), ("The knight on f3 attacks the knight on c6.", False), ("There is no en passant.", True), ("You may take en passant.", False),
    ("White has three knights.", False), ("Black is up material.", False), ("The pawn on e5 is undefended.", False), ("It gives check.", False), ("It takes the pawn.", True),
])
def test_claims(text, ok):
    clean, bad = claims.verify(text, OPEN, "f3e5", extended=True)
    assert (not bad) == ok and (clean == text) == ok


def test_true_on_either_board_wins():
    assert not claims.verify("Black to move. White to move.", OPEN, "f1b5", True)[1]
    assert claims.verify("Black to move.", OPEN, None, True)[1]
    assert claims.verify("Anything at all.", "no position") == ("Anything at all.", [])


@pytest.mark.parametrize("text,uci", [
    ("I'd play Nxe5. Rather than Bc4.", "f3e5"), ("Instead of Nxe5, develop: Bc4 is calm.", "f1c4"), ("Avoid Nxe5.", None), ('{"recommended_move_uci": "f1b5"} but Nxe5', "f1b5"), ("You played d4. I'd play d4 again.", "d2d4"),
])
def test_recommendations(text, uci):
    assert claims.recommendation(text, OPEN, "d2d4")[0] == uci
    assert claims.recommendation("nothing", OPEN, "d2d4", ["f1b5"]) == ("f1b5", "fallback")


@pytest.mark.parametrize("text,fen,uci,reason", [
    ("The bishop on b2 attacks the knight on f6.", "4k3/8/5n2/8/8/8/1B6/4K3 w - - 0 1", None, None),
    ("The knight on c5 attacks the bishop on e5.", "4k3/8/8/2N1b3/8/8/8/4K3 w - - 0 1", None, "does not attack the bishop on e5"),
    ("The rook on a1 defends the pawn on h2.", "4k3/8/8/8/8/8/7P/R3K3 w - - 0 1", None, "does not defend the pawn on h2"),
    ("The bishop on g5 pins the knight on f6.", "4k3/4q3/5n2/6B1/8/8/8/4K3 w - - 0 1", None, None),
    ("The bishop on g5 pins the knight on f6.", "4k3/8/5n2/6B1/8/8/8/4K3 w - - 0 1", None, "does not pin the knight on f6"),
    ("Playing Nf3 captures the bishop on e5.", "4k3/8/8/4b3/8/8/8/4K1N1 w - - 0 1", None, "Nf3 does not capture anything"),
    ("Nxe5 captures the bishop on e5.", "4k3/8/8/4b3/8/5N2/8/4K3 w - - 0 1", None, None), ("Nf3 gives check.", START, None, "Nf3 does not give check"),
    ("This develops the knight from b1 to f3.", START, "g1f3", "the move goes from g1, not b1"), ("This develops the knight from g1 to f3.", START, "g1f3", None),
    ("It is Black to move here.", START, None, "it is White to move, not Black"), ("White can castle kingside.", "r3k2r/8/8/8/8/8/8/4K3 w - - 0 1", None, "White has no kingside castling rights"),
    ("White has both rooks ready.", "4k3/8/8/8/8/8/8/R3K3 w - - 0 1", None, "White has 1 rook(s), not 2"), ("White has two bishops.", "4k3/8/8/8/8/8/8/2B1KB2 w - - 0 1", None, None),
    ("White is up a pawn.", "r3k3/8/8/8/8/8/8/4K3 b - - 0 1", None, "White is not up material"), ("The rook on a1 is hanging.", "4k3/8/8/8/8/8/R7/R3K3 w - - 0 1", None, "the rook on a1 is not hanging"),
    ("The knight on d4 is hanging.", "3rk3/8/8/8/3N4/8/8/4K3 w - - 0 1", None, None), ("The knight on d4 is undefended.", "4k3/8/8/8/3N4/8/3R4/4K3 w - - 0 1", None, "the knight on d4 is defended, not undefended"),
    ("The bishop on b2 attacks the knight at f6.", "4k3/8/5n2/8/3P4/8/1B6/4K3 w - - 0 1", None, "does not attack the knight on f6"), ("Nc5 attacks the bishop on e5.", "4k3/8/8/4b3/8/3N4/8/4K3 w - - 0 1", None, "does not attack the bishop on e5"),
    ("Nc5 attacks the knight on e4.", "4k3/8/8/8/4n3/3N4/8/4K3 w - - 0 1", None, None), ("After Nf3, the knight attacks the bishop on e5.", "4k3/8/8/4b3/8/8/8/4K1N1 w - - 0 1", "g1f3", None),
    ("After Nf3, the knight attacks the bishop on d5.", "4k3/8/8/3b4/8/8/8/4K1N1 w - - 0 1", "g1f3", "does not attack the bishop on d5"), ("The knight on c5 attacks the bishop on e5.", "4k3/8/8/2N1b3/8/8/8/4K3 w - - 0 1", "e1d1", "does not attack the bishop on e5"),
    ("Control the center and develop your pieces before starting an attack.", START, None, None), ("The queen on a1 is a monster.", START, None, "no queen on a1"), ("The queen at a1 is a monster.", START, None, "no queen on a1"),
])
def test_reasons_of_false_claims(text, fen, uci, reason):
    clean, bad = claims.verify(text, fen, uci, True)
    assert [r for _, r in bad] == ([reason] if reason else []) and clean == ("" if reason else text)


KINGS = "8/8/4k2p/1R6/7P/rp3KP1/8/8 b - - 5 46"


@pytest.mark.parametrize("text,fen,student,uci", [
    ("I'd play Kd6. Play Kd6 again, it is calm. Run a checklist before a forcing-looking move like ...b2+. It leads to Kd6 rather than rushing into checks.", KINGS, "e6d6", "e6d6"),
    ("Play Kd6 again.", KINGS, "e6d6", "e6d6"), ("You could try b2+. Play Kd6 again!", KINGS, "e6d6", "e6d6"), ("Your Nc3 is playable, but I'd play Bb5 instead.", OPEN, "b1c3", "f1b5"),
    ("Instead of a slow move such as Nc3, Na3, the move is Bb5.", OPEN, "d2d4", "f1b5"), ("Nothing like Rg1, Be2, or even Bd3: Bb5 is better.", OPEN, None, "f1b5"), ("If Black waits, you have Bc4 as a follow-up. Bb5 then.", OPEN, None, "f1b5"),
    ("Control the d4 square first. The plan Bb5 develops.", OPEN, None, "f1b5"), ("A pawn goes to d4; Bb5.", OPEN, None, "f1b5"), ("Be2 was fine. Bb5!", OPEN, None, "f1b5"), ("Look: d4 opens lines.", OPEN, "d2d4", "d2d4"), ("Never Ba6.", OPEN, None, None),
])
def test_manner_of_mention(text, fen, student, uci):
    assert claims.recommendation(text, fen, student)[0] == uci


def test_facts():
    p = Position.of(OPEN)
    f = facts.move_facts(p, p.parse_uci("f1b5"))
    assert f["san"] == "Bb5" and f["develops"] and f["attacks"] == [("c6", "knight")] and not f["is_check"]
    assert facts.solver_position(START, "e2e4 e7e5").startswith("rnbqkbnr/pppppppp/8/8/4P3") and facts.solver_position(START, "e2e5") is None
    assert "capture_available" in facts.tags(p, [])[0] and facts.fact_sheet("x", []) == "" and "Bb5" in facts.fact_sheet(OPEN, ["f1b5"])
    assert not claims.verify(facts.plain_coaching(OPEN, "f1b5"), OPEN, "f1b5", True)[1]


def test_columns(spark):
    rows = spark.createDataFrame([(OPEN, "f3e5", None, "I'd play Nxe5. The knight on a1 sleeps."), ("bad", "a", "b", None), (None, None, None, None), (OPEN, None, "Bb5", "{x} {\"a\": 1}")], "fen string, uci string, san string, text string")
    got = rows.select(columns.move_is_legal("fen", "uci", "san").alias("l"), columns.hanging_squares("fen").alias("h"), columns.move_facts("fen", "uci").alias("m"), columns.motif_tags("fen", F.array("uci")).alias("t"), columns.verify_text("text", "fen", "uci").alias("v"),
                      columns.verify_text_extended("text", "fen", "uci").alias("x"), columns.recommendation("text", "fen", F.lit("d2d4"), F.lit(None).cast("array<string>")).alias("r"), columns.first_json_object("text").alias("j"), columns.solver_position("fen", "uci").alias("s"), columns.fact_sheet("fen", F.array("uci")).alias("f"), columns.plain_coaching("fen", "uci").alias("p")).collect()
    assert [(r.l.legal, r.l.uci) for r in got] == [(True, "f3e5"), (False, None), (False, None), (True, "f1b5")]
    assert got[0].m.captured == "pawn" and len(got[0].v.violations) == 1 and got[0].r.uci == "f3e5" and got[3].j == '{"a": 1}' and got[1].t.tags is None


@pytest.mark.parametrize("raw,status", [("", 400), ("8/8", 422), (OPEN, 200), (f"  {OPEN} ", 200), ("9/8/8/8/8/8/8/8 w - - 0 1", 422), ("7k/5Q2/6K1/8/8/8/8/8 b - - 0 1", 422), (OPEN.rsplit(" ", 1)[0], 422)])
def test_validation(raw, status):
    import pandas as pd

    assert columns.validated_position.func(pd.Series([raw])).status[0] == status


def test_a_worker_judges_equal_rows_once(monkeypatch):
    import pandas as pd

    from sievework.board import claims, columns

    asked = []
    own = claims.verify
    monkeypatch.setattr(claims, "verify", lambda *a: asked.append(a) or own(*a))
    fen = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3"
    texts = pd.Series([f"The knight on {s} is strong. Version {i % 3} of once." for i in range(300) for s in ("f3", "a1")])
    got = columns.verify_text.func(texts, pd.Series([fen] * 600), pd.Series([None] * 600))
    assert len(asked) == 6
    assert [len(v) for v in got.violations] == [0, 1] * 300 and list(got.clean[:2]) == ["The knight on f3 is strong. Version 0 of once.", "Version 0 of once."]


def test_fact_sheets_judge_distinct_boards_only(spark):
    from __spark_entry__ import queries

    plan = queries()["move_fact_sheet"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("ArrowEvalPython") < plan.index("Aggregate")
