"""Column functions that band, label and score one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level bands (inclusive, with gaps), their line caps, and the cut points of loss.
LEVELS = ("beginner", "intermediate", "advanced")
BANDS = {"beginner": (1000, 1200), "intermediate": (1300, 1600), "advanced": (1700, 2000)}
LINE_CAPS = {"beginner": 2, "intermediate": 4, "advanced": 6}
SOUND_TOLERANCE, BLUNDER, MISTAKE, INACCURACY = 150, 250, 100, 50
STRATA = (600, 1000, 1300, 1600, 1900, 2200, 2600)
COARSE = (0, 800, 1200, 1600, 2000, 2400, 3600)
CENTRES = (800, 1200, 1600, 2000, 2400)
POLICY_BINS = (">=.50", ".25-.50", ".10-.25", ".05-.10", "<.05")
WIN_BAND, LOSS_BAND, WDL_DROP, ENDORSE_LOSS, CORRECT_LOSS = 0.75, 0.25, 0.10, 30, 90


def level_band(rating: Column) -> Column:
    """The level whose inclusive band holds the rating; null in the gaps and for null."""
    out = F.lit(None).cast("string")
    for name, (low, high) in BANDS.items():
        out = F.when(rating.between(low, high), name).otherwise(out)
    return out


def level_cut(rating: Column) -> Column:
    """Half-open cut points: below 1300, below 1700, and the rest."""
    return F.when(rating < 1300, "beginner").when(rating < 1700, "intermediate").when(rating.isNotNull(), "advanced")


def range_label(value: Column, edges: tuple[int, ...] = STRATA) -> Column:
    """'low-high' of the half-open range that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value >= low) & (value < high), f"{low}-{high}").otherwise(out)
    return out


def window_bucket(value: Column, centres: tuple[int, ...] = CENTRES, reach: int = 100) -> Column:
    """The first centre within reach, inclusive."""
    out = F.lit(None).cast("int")
    for c in reversed(centres):
        out = F.when(value.between(c - reach, c + reach), c).otherwise(out)
    return out


def severity(loss: Column) -> Column:
    return F.when(loss < INACCURACY, "none").when(loss < MISTAKE, "inaccuracy").when(loss < BLUNDER, "mistake").when(loss.isNotNull(), "blunder")


def clamped_loss(best: Column, played: Column) -> Column:
    return F.greatest(F.lit(0), best - played)


def policy_bin(policy: Column) -> Column:
    return F.when(policy >= 0.50, POLICY_BINS[0]).when(policy >= 0.25, POLICY_BINS[1]).when(policy >= 0.10, POLICY_BINS[2]).when(policy >= 0.05, POLICY_BINS[3]).when(policy.isNotNull(), POLICY_BINS[4])


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "na").when(rank <= 0, "best").when(rank <= 2, "near").when(rank <= 5, "mid").otherwise("tail")


def fen_field(fen: Column, i: int) -> Column:
    return F.get(F.split(fen, " "), F.lit(i))


def phase_by_material(fen: Column) -> Column:
    """Major and minor pieces and the move number."""
    pieces = F.length(F.regexp_replace(fen_field(fen, 0), "[^QRBNqrbn]", ""))
    return F.when(pieces <= 6, "endgame").when(fen_field(fen, 5).cast("int") <= 12, "opening").otherwise("middlegame")


def phase_by_count(fen: Column) -> Column:
    """Letters in the placement alone."""
    pieces = F.length(F.regexp_replace(fen_field(fen, 0), "[^A-Za-z]", ""))
    return F.when(pieces >= 26, "opening").when(pieces >= 12, "middlegame").otherwise("endgame")


def phase_by_queens(fen: Column) -> Column:
    """Piece count, aware of queens, then the move number."""
    placement = fen_field(fen, 0)
    pieces = F.length(F.regexp_replace(placement, "[^A-Za-z]", ""))
    queens = F.length(F.regexp_replace(placement, "[^Qq]", ""))
    return F.when((pieces <= 12) | ((queens == 0) & (pieces <= 16)), "endgame").when(fen_field(fen, 5).cast("int") <= 12, "opening").otherwise("middlegame")


def expected_score(wdl: Column) -> Column:
    """(win + draw / 2) over the total; null unless there are three values with a positive total."""
    total = F.get(wdl, F.lit(0)) + F.get(wdl, F.lit(1)) + F.get(wdl, F.lit(2))
    return F.when((F.size(wdl) == 3) & (total > 0), (F.get(wdl, F.lit(0)) + F.get(wdl, F.lit(1)) / 2) / total)


def outcome_band(expected: Column) -> Column:
    return F.when(expected >= WIN_BAND, "win").when(expected <= LOSS_BAND, "loss").when(expected.isNotNull(), "draw")


#: Result for the side to move of a table-base category of the position after its move.
TABLEBASE = {"win": "loss", "maybe-win": "loss", "cursed-win": "draw", "draw": "draw", "blessed-loss": "draw", "maybe-loss": "win", "loss": "win"}


def tablebase_result(category: Column) -> Column:
    """The opponent's category turned into one's own three-band result; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TABLEBASE.items() for x in kv]), category)


def position_key(fen: Column, fields: int = 4) -> Column:
    """The first two or four fields of an encoded board; null unless it has them."""
    parts = F.split(F.trim(fen), " ")
    return F.when(F.size(parts) >= fields, F.concat_ws(" ", F.slice(parts, 1, fields)))


def position_key_of_drawing(text: Column) -> Column:
    """placement and side of a board drawn as eight lines of spaced symbols after 'Board:'."""
    lines = F.slice(F.split(F.regexp_extract(text, r"(?s)Board:\s*\n(.*)", 1), "\n"), 1, 8)

    def packed(line: Column) -> Column:
        out = F.regexp_replace(line, r"\s", "")
        for n in range(8, 0, -1):
            out = F.replace(out, F.lit("." * n), F.lit(str(n)))
        return out

    side = F.when(F.contains(text, F.lit("White to move")), "w").when(F.contains(text, F.lit("Black to move")), "b")
    return F.when((F.size(lines) == 8) & side.isNotNull(), F.concat_ws(" ", F.array_join(F.transform(lines, packed), "/"), side))


def drawing_of_board(fen: Column) -> Column:
    """Eight lines of spaced symbols, empty squares as dots."""

    def line(rank: Column) -> Column:
        out = rank
        for n in range(1, 9):
            out = F.replace(out, F.lit(str(n)), F.lit("." * n))
        return F.trim(F.regexp_replace(out, "(.)", "$1 "))

    return F.array_join(F.transform(F.split(fen_field(fen, 0), "/"), line), "\n")


def group_of_id(item_id: Column) -> Column:
    """What stands before '#'; without the last _suffix, unless it begins with puz_."""
    base = F.substring_index(item_id, "#", 1)
    return F.when(F.startswith(base, F.lit("puz_")), base).otherwise(F.regexp_replace(base, "_[^_]*$", ""))


def first_by_priority(tags: Column, priority: list[str], ignore: list[str], default: str = "other") -> Column:
    """First of the priority list that is present; else the first tag that is not ignored; else the default."""
    ranked = F.array_intersect(F.array(*map(F.lit, priority)), tags)
    rest = F.filter(tags, lambda t: ~t.isin(*ignore)) if ignore else tags
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(rest, F.lit(0)), F.lit(default))


def even_places(n: Column, skip_open: int, skip_end: int, most: int) -> Column:
    """At most `most` places spread evenly over [skip_open, n - skip_end), sorted and distinct."""
    low, span = F.lit(skip_open), n - skip_end - skip_open
    k = F.least(F.lit(most), span)
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(F.floor(low + span / k * (j + F.lit(0.5))).cast("int"), n - skip_end - 1))
    return F.when(span > 0, F.array_sort(F.array_distinct(at))).otherwise(F.array().cast("array<int>"))


def balanced_quota(total: int, names: tuple[str, ...] = LEVELS) -> dict[str, int]:
    each, extra = divmod(total, len(names))
    return {name: each + (i < extra) for i, name in enumerate(names)}


def robust_score(agree: Column, band: Column, best_band: Column, cp: Column, best_cp: Column) -> Column:
    """+2 if both depths agree (null agrees), +1 in the best one's band, minus one for each 40 of gap."""
    same = F.coalesce((band == best_band).cast("int"), F.lit(0))
    return F.when(F.coalesce(agree, F.lit(True)), 2).otherwise(0) + same - F.floor(F.greatest(F.lit(0), best_cp - cp) / 40)


def review_action(has_student: Column, drops_band: Column, loss: Column, in_pool: Column) -> Column:
    drops, inside = F.coalesce(drops_band, F.lit(False)), F.coalesce(in_pool, F.lit(False))
    return F.when(~has_student, "none").when(drops | F.coalesce(loss > CORRECT_LOSS, F.lit(False)), "correct").when((loss <= ENDORSE_LOSS) & inside, "endorse").when(inside, "soft").otherwise("correct")


def sampling_weight(high_confidence: Column, discriminating: Column) -> Column:
    return F.when(high_confidence, 1.5).when(discriminating, 1.0).otherwise(0.25)


def cell_quality(sound: Column, fit: Column, fabricated: Column, move: Column, instruction: Column) -> Column:
    """Twice the fit, plus soundness, less twice fabrication, plus grades over five; null terms count nothing."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return 2 * number(fit) + number(sound) - 2 * number(fabricated) + number(move) / 5 + number(instruction) / 5


def cell_quality_raw_grades(sound: Column, fit: Column, fabricated: Column, move: Column, instruction: Column) -> Column:
    """The viewer's variant: grades are added as they are."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return 2 * number(fit) + number(sound) - 2 * number(fabricated) + number(move) + number(instruction)


def first_that(items: Column, *tests) -> Column:
    """The first item that passes the first test, else the second, and so on; null if none does."""
    return F.coalesce(*[F.get(F.filter(items, t), F.lit(0)) for t in tests])


def triad_class(b: Column, i: Column, a: Column) -> Column:
    """all_same, collapse_BA, BI, IA or full; null unless all three are there."""
    whole = b.isNotNull() & i.isNotNull() & a.isNotNull()
    return F.when(~whole, None).when((b == i) & (i == a), "all_same").when(b == a, "collapse_BA").when(b == i, "BI").when(i == a, "IA").otherwise("full")


def triad_pattern(b: Column, i: Column, a: Column) -> Column:
    """The second rule's names."""
    return F.when((b == i) & (i == a), "B=I=A").when((b == i) & (i != a), "B=I!=A").when((i == a) & (b != a), "I=A!=B").when((b == a) & (i != a), "B=A!=I").otherwise("B!=I!=A")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval, clamped to [0, 1]; (0, 0) for no trials."""
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null; null if none is."""
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(den > 0, num / den)


def hash_fraction(key: Column) -> Column:
    """The first eight hex digits of SHA-256 over 2^32 - 1: a fixed number in [0, 1] for each key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295)
