"""Column functions over text: detectors, cleaners, renderers, rubrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.buckets import LEVELS

# ---- fixed values: patterns, in order ----
#: Leaks of analysis internals, gate variant. Nothing else may stand for these.
LEAKS = (r"(?i)\d+\s*cp\b", r"(?i)\bcentipawns?\b", r"(?i)\beval", r"(?i)\bengines?\b", r"(?i)\bstockfish\b", r"(?i)\bcomputers?\b", r"#\d", r"(?<!\w)[+-]\d+\.\d+", r"(?<!\w)[+-]\d")
#: Audit variant: one pattern.
LEAKS_AUDIT = r"(?i)\b(centipawn|stockfish|engine|computer|eval(?:uation)?|winning by|mate in \d|depth \d|the machine)\b|[+\-]\d+(?:\.\d+)?\s*(?:cp|pawns?)?\b|\bcp\b"
#: Distilling variant.
LEAKS_DISTILL = r"(?i)\b(centipawn|stockfish|engine|computer|eval(uation)?|\+\d|\-\d(?!\d*[a-z])|winning by|mate in \d)\b"
#: A move in short notation; a move number alone; a move number glued to a move.
MOVE_TOKEN = r"^(?:O-O(?:-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)[+#]?$"
MOVE_NUMBER, LEADING_NUMBER = r"^\d+\.+$", r"^\d+\.+"
#: Inverted slogans by name.
BAD_HEURISTICS = (
    ("trade_when_behind", r"(?i)\b(?:trade|exchang\w+|simplif\w+|swap\w*)\b[^.]{0,60}?\b(?:when|if|because|since|while)\b[^.]{0,30}?\b(?:behind|losing|worse|down (?:in )?material|at a disadvantage)\b"),
    ("trade_when_behind_rev", r"(?i)\b(?:when|if|because|since|while)\b[^.]{0,30}?\b(?:behind|losing|worse|down (?:in )?material|at a disadvantage)\b[^.]{0,50}?\b(?:trade|exchang\w+|simplif\w+|swap\w*)\b"),
    ("passed_must_push", r"(?i)\bpassed pawns?\b[^.]{0,20}\bmust\b[^.]{0,15}\b(?:be pushed|push|advance)\b"),
    ("always_push_passed", r"(?i)\balways\b[^.]{0,15}\bpush\w*\b[^.]{0,15}\bpassed\b"),
    ("always_castle", r"(?i)\b(?:always castle|must always castle|castl\w+ is always (?:the )?(?:right|best|priority)|you (?:should )?always castle)\b"),
    ("bishop_pair_always", r"(?i)\b(?:bishop pair|two bishops)\b[^.]{0,15}\b(?:is|are)\b[^.]{0,10}\balways\b[^.]{0,15}\b(?:better|stronger|good)\b"),
    ("space_always_good", r"(?i)\bspace\b[^.]{0,20}\b(?:is )?always\b[^.]{0,10}\b(?:good|better|an advantage)\b"),
    ("always_grab_pawn", r"(?i)\balways\b[^.]{0,10}\b(?:grab|take|snatch|win)\b[^.]{0,15}\b(?:free )?pawn\b"),
    ("queen_out_early_good", r"(?i)\bbring\b[^.]{0,15}\bqueen\b[^.]{0,15}\bout\b[^.]{0,15}\bearly\b[^.]{0,20}\b(?:to be active|for activity|is good|to attack)\b"),
)
#: Named principles, in order.
PRINCIPLES = (
    ("development", r"(?i)\b(develop(?:ing|ment|ed)?|undeveloped|bring .{0,20}\b(?:into the game|out)|finish(?:ing)? development|get .{0,15} developed)\b"),
    ("king_safety", r"(?i)\b(king safety|castl\w+|king (?:is )?(?:still )?in the cent|safeguard\w* .{0,10}king|king stuck|tuck\w* .{0,10}king|get your king|expos\w* king)\b"),
    ("center", r"(?i)\b(cent(?:er|re|ral)|control the cent|central (?:control|square|pawn))\b"),
    ("open_file_rook", r"(?i)\b((?:half[- ]?)?open file|rook .{0,12}(?:file|column)|file for (?:your|the) rook|contest the .{0,6}file)\b"),
    ("seventh_rank", r"(?i)\b(seventh rank|7th rank|on the (?:7th|seventh)|rook .{0,10}(?:7th|seventh))\b"),
    ("doubled_rooks", r"(?i)\b(doubl\w* .{0,6}rooks?|stack\w* .{0,6}rooks?|connect\w* .{0,6}rooks?|rooks? .{0,10}doubl)\b"),
    ("passed_pawn", r"(?i)\b(passed pawn|passer|push .{0,12}(?:passed )?pawn|promot\w+|queen(?:ing)? .{0,8}pawn|outside passed)\b"),
    ("prophylaxis", r"(?i)\b(prophyla\w+|prevent\w*|stop\w* .{0,18}(?:plan|idea|break|threat)|take away|deny\w*|restrict\w*|shut down .{0,12}(?:plan|idea))\b"),
    ("outpost", r"(?i)\b(outpost|strong (?:knight )?square|permanent square|anchor)\b"),
    ("bishop_pair", r"(?i)\b(bishop pair|two bishops|pair of bishops)\b"),
    ("good_bad_bishop", r"(?i)\b(bad bishop|good bishop|active bishop|improve .{0,12}bishop|reroute .{0,12}bishop)\b"),
    ("trade_logic", r"(?i)\b(trad\w+|exchang\w+|swap\w*|simplif\w+|off the board)\b"),
    ("activity_worst_piece", r"(?i)\b(activ\w+|improve your worst|worst piece|most passive|passive piece|reroute|maneuver|manoeuvre|reposition)\b"),
    ("space", r"(?i)\b(space (?:advantage|edge)?|gain space|gaining space|cramp\w*|more space)\b"),
    ("initiative_tempo", r"(?i)\b(initiative|with tempo|gain(?:ing)? a tempo|develop with tempo|tempo\b)\b"),
    ("weakness_target", r"(?i)\b(weak(?:ness| ?square)?|isolated pawn|isolated queen|backward pawn|doubled pawns?|create a target|fix .{0,10}(?:pawn|weak))\b"),
    ("endgame", r"(?i)\b(opposition|key square|active king|rook behind|zugzwang|triangulat\w+)\b"),
)
TACTICS = (
    ("fork", r"(?i)\bfork\w*\b"), ("pin", r"(?i)\bpin\w*\b"), ("skewer", r"(?i)\bskewer\w*\b"), ("discovered", r"(?i)\bdiscover\w*\b"),
    ("double_attack", r"(?i)\b(double attack|two threats|two targets|attack .{0,12}(?:two|both))\b"), ("overload_deflect", r"(?i)\b(overload\w*|deflect\w*|remove the defender|overwork\w*)\b"),
    ("trapped", r"(?i)\b(trap\w*|no squares|no safe square)\b"), ("hanging_counting", r"(?i)\b(hanging|undefended|loose piece|count .{0,12}(?:attackers|defenders)|attackers? .{0,6}(?:and|vs) .{0,6}defenders?)\b"),
)
#: Clause of each principle, and whether it suits beginners.
CLAUSES = {
    "development": ("Develop your pieces before you attack", True), "king_safety": ("King safety first — get your king out of the center", True), "center": ("Fight for the center", True),
    "open_file_rook": ("Put your rooks on open files", True), "seventh_rank": ("A rook on the seventh rank is powerful", True), "doubled_rooks": ("Double your rooks so they support each other", True),
    "passed_pawn": ("Support a passed pawn before you push it", True), "prophylaxis": ("Take away your opponent's idea first", True), "outpost": ("Plant a knight on a strong outpost", False),
    "bishop_pair": ("Use the bishop pair in open positions", False), "good_bad_bishop": ("Improve your bad bishop", False), "trade_logic": ("Weigh every trade by what it changes", True),
    "activity_worst_piece": ("Improve your worst-placed piece", True), "space": ("Use your space to prepare a break", True), "initiative_tempo": ("Keep the initiative", False),
    "weakness_target": ("Target the weak pawn", True), "endgame": ("An active king is a strong piece in the endgame", True),
}
#: Which principle of the body comes first.
PRIORITY = ("king_safety", "development", "center", "passed_pawn", "open_file_rook", "seventh_rank", "doubled_rooks", "outpost", "good_bad_bishop", "weakness_target", "prophylaxis", "activity_worst_piece", "space", "trade_logic", "bishop_pair", "initiative_tempo", "endgame")
#: Part of a concept's name -> principle, in order.
CONCEPTS = (
    ("develop", "development"), ("castl", "king_safety"), ("king safety", "king_safety"), ("center", "center"), ("central", "center"), ("open file", "open_file_rook"), ("seventh", "seventh_rank"), ("7th", "seventh_rank"),
    ("passed", "passed_pawn"), ("passer", "passed_pawn"), ("promot", "passed_pawn"), ("prophyl", "prophylaxis"), ("prevent", "prophylaxis"), ("outpost", "outpost"), ("bishop pair", "bishop_pair"), ("bad bishop", "good_bad_bishop"),
    ("good bishop", "good_bad_bishop"), ("trade", "trade_logic"), ("exchange", "trade_logic"), ("simplif", "trade_logic"), ("initiative", "initiative_tempo"), ("tempo", "initiative_tempo"), ("space", "space"), ("weak", "weakness_target"),
    ("isolated", "weakness_target"), ("backward", "weakness_target"), ("worst piece", "activity_worst_piece"), ("passive", "activity_worst_piece"), ("activ", "activity_worst_piece"), ("endgame", "endgame"), ("opposition", "endgame"),
)
SCRUBS = ((r"(?i)\bwith tempo\b", "for free"), (r"(?i)\bgain(?:ing|s)?\s+a?\s*tempo\b", "gain time"), (r"(?i)\ba tempo\b", "time"), (r"(?i)\btempi\b", "moves"), (r"(?i)\btempo\b", "time"), (r"(?i)\bthe initiative\b", "the attack"), (r"(?i)\binitiative\b", "pressure"))
ROUTINE = r"(?i)\b(ask|look for|look at|check|scan|count|first|before you|every|which|spot|find|consider|compare|when you)\b"
CONTRAST = r"(?i)\b(at your level|a stronger player|stronger player|simpler|for now|just as sound|easier to handle|easier to play|keep it simple)\b"
PURPOSE = r"(?i)\b(develops?|attacks?|defends?|controls?|opens?|improves?|creates?|protects?|targets?|activates?|prepares?|threatens?|guards?|covers?|supports?|blocks?|stops?|frees?|connects?|centralizes?|gains?|wins?|trades?|removes?|pressures?|hits?|eyes?)\b"
LENGTH_BANDS = {"beginner": (55, 145), "intermediate": (85, 185), "advanced": (100, 225)}
_MOVE = r"(?:O-O-O|O-O|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?)"
LEAD_RESTATED = (
    rf"(?i)^\s*(?:the\s+move\s*:\s*(?:{_MOVE}\b[\s.:,;!\-]*)?|the\s+move\s+is(?:\s+to\s+play|\s+to)?\s+(?:{_MOVE}\b[\s.:,;!\-]*)?|this\s+is\s+the\s+move\b[\s.:,;!\-]*"
    rf"|the\s+move\s+to\s+(?:play|learn|focus)(?:\s+on)?\s+(?:{_MOVE}\b[\s.:,;!\-]*)?|(?:i['’]?d\s+play|let['’]?s\s+play|we['’]?d\s+play|we\s+play|go\s+with|play|consider)\s+{_MOVE}\b[\s.:,;!\-]*)"
)
LEAD_DANGLING = r"(?i)^\s*[—–\-,]?\s*(?:and|but|so|then|in fact)\b[\s,]*"
LEAD_PUNCT = r"^[\s.,;:!—–\-]+"
AUDIT_RESTATED = r"(?i)^\s*(THE MOVE\s*:|The move is\b|This is the move\b|Play\s+\S+\.|Consider\s+\S+\.|Let'?s play\b|The move to (?:play|learn|focus)\b|I'?d play\b)"
AUDIT_DANGLING = r"(?i)^\s*[—\-–]\s*(and|but|so|then|in fact)\b"
#: Ratings of each level, and plies that a short answer may narrate.
LEVEL_RATINGS = {"beginner": (1000, 1200, 2), "intermediate": (1300, 1600, 4), "advanced": (1700, 2000, 6)}
#: What a short answer advises in each phase, and otherwise.
PHASE_ADVICE = {"endgame": "activate your king and keep your pieces coordinated", "opening": "develop toward the center and get your king safe", "middlegame": "improve your worst-placed piece and watch your opponent's ideas"}
OTHER_ADVICE = "make a purposeful, safe improving move"
SHORT_ASK = "Recommend exactly ONE move that is genuinely sound AND the most instructive for a {level} player{why} Keep any concrete line within {plies} plies."
SHORT_FORM = (
    "Format your reply as plain prose in exactly this shape:\nStart with \"I'd play <MOVE>.\" where <MOVE> is one move in standard algebraic notation (e.g. Nf3, exd5, O-O). Then give one short sentence of coaching in "
    "plain, encouraging language. End with one line \"Takeaway: <one transferable sentence>.\" Do not output JSON, bullet lists, headers, or long move-number sequences."
)
# ---- end of fixed values ----


def leaks(text: Column, patterns: tuple[str, ...] = LEAKS) -> Column:
    """Distinct snippets that any of the patterns finds, by pattern, then by place."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return F.array_distinct(F.concat(*found))


def longest_run(tokens: Column, member, transparent=None, stop=None) -> Column:
    """Longest run of tokens that `member` holds for; transparent tokens neither count nor break a run; `stop` ones break it."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(member(t), s["run"] + 1).otherwise(0)
        if stop is not None:
            run = F.when(stop(t), 0).otherwise(run)
        if transparent is not None:
            run = F.when(transparent(t), s["run"]).otherwise(run)
        return F.struct(F.greatest(s["best"], run).alias("best"), run.alias("run"))

    return F.aggregate(tokens, start, step, lambda s: s["best"])


def _move_tokens(text: Column, numbers: bool) -> Column:
    raw = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"""^[\s()\[\]{}"']+|[\s()\[\]{}"']+$""", ""))
    if not numbers:
        return F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[,.:;!?()]+|[,.:;!?()]+$", ""))
    return F.transform(raw, lambda t: F.when(t.rlike(MOVE_NUMBER), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(t, r"[.,;:!?]+$", ""), LEADING_NUMBER, "")))


def longest_move_run(text: Column) -> Column:
    """Gate variant: move numbers are transparent."""
    return longest_run(_move_tokens(text, True), lambda t: t.rlike(MOVE_TOKEN), lambda t: t == "")


def longest_move_run_eval(text: Column) -> Column:
    """Evaluation variant: move numbers are transparent, game results break the run."""
    return longest_run(_move_tokens(text, True), lambda t: t.rlike(MOVE_TOKEN), lambda t: t == "", lambda t: t.isin("1-0", "0-1", "1/2-1/2", "*"))


def longest_move_run_audit(text: Column) -> Column:
    """Audit variant: no handling of move numbers."""
    return longest_run(_move_tokens(text, False), lambda t: t.rlike(MOVE_TOKEN))


def first_named(text: Column, named: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first pattern that the text holds; null if none."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in named])


def all_named(text: Column, named: tuple[tuple[str, str], ...]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in named]), lambda x: x.isNotNull())


def bad_heuristic(text: Column) -> Column:
    return first_named(text, BAD_HEURISTICS)


def names_principle(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for _, p in PRINCIPLES])


def squeezed(text: Column) -> Column:
    """Blanks squeezed to one space and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_lead(text: Column, passes: int = 6) -> Column:
    """Leading restatements of the move, dangling connectives and punctuation go; the first letter is raised."""
    out = F.trim(text)
    for _ in range(passes):
        for pattern in (LEAD_RESTATED, LEAD_DANGLING, AUDIT_RESTATED, AUDIT_DANGLING, LEAD_PUNCT):
            out = F.regexp_replace(out, pattern, "")
        out = F.trim(out)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))


def beginner_scrub(text: Column, level: Column) -> Column:
    out = text
    for pattern, plain in SCRUBS:
        out = F.regexp_replace(out, pattern, plain)
    return F.when(level == "beginner", out).otherwise(text)


def takeaway_with_principle(takeaway: Column, body: Column, concepts: Column, level: Column) -> tuple[Column, Column]:
    """(takeaway, augmented): a principle's clause goes before a takeaway that names none.

    The clause is of the body's first principle by priority, else of the first concept that is known, else the level's default.
    """
    families = dict(PRINCIPLES)
    suits = lambda f: F.lit(True) if CLAUSES[f][1] else level != "beginner"
    joined = F.lower(F.array_join(concepts, " "))
    chosen = F.coalesce(
        *[F.when(suits(f) & body.rlike(families[f]), F.lit(f)) for f in PRIORITY],
        *[F.when(suits(f) & F.contains(joined, F.lit(part)), F.lit(f)) for part, f in CONCEPTS],
        F.when(level == "beginner", F.lit("development")).otherwise(F.lit("activity_worst_piece")),
    )
    clause = F.element_at(F.create_map(*[F.lit(x) for f, (c, _) in CLAUSES.items() for x in (f, c)]), chosen)
    named = names_principle(takeaway)
    longer = F.when(takeaway == "", F.concat(clause, F.lit("."))).otherwise(F.concat(clause, F.lit(". "), takeaway))
    return F.when(named, takeaway).otherwise(F.trim(longer)), ~named


def rendered_target(move: Column, body: Column, method: Column, takeaway: Column) -> Column:
    """Move, why, how to find it (if there is a method), and the takeaway; blanks squeezed."""
    lead = F.trim(F.concat(F.lit("I'd play "), move, F.lit(". "), body))
    how = F.when(F.coalesce(method, F.lit("")) != "", F.concat(F.lit(" How to find it: "), method)).otherwise("")
    return F.regexp_replace(F.trim(F.concat(lead, how, F.lit(" Takeaway: "), takeaway)), "  +", " ")


def split_target(text: Column) -> tuple[Column, Column]:
    """(body, takeaway): split at the first marker; the takeaway is one line."""
    parts = F.split(text, "(?i)takeaway:", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^\s*([^\n]*)", 1))


def instructiveness(target: Column, body: Column, method: Column, takeaway: Column, concepts: Column, level: Column, move: Column) -> Column:
    """The rubric's score, to three places."""
    squares = F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b([a-h][1-8])\b"), F.lit(1))))
    filled = F.size(F.filter(concepts, lambda c: F.trim(c) != ""))
    words = F.size(F.filter(F.split(target, r"\s+"), lambda w: w != ""))
    edge = lambda i: F.element_at(F.create_map(*[F.lit(x) for k in LEVELS for x in (k, LENGTH_BANDS[k][i])]), level)
    off = F.greatest(edge(0) - words, words - edge(1))
    repeats = F.when(F.coalesce(move, F.lit("")) == "", 0).otherwise((F.length(target) - F.length(F.replace(target, move, F.lit("")))) / F.length(move))
    yes = lambda test, gain: F.when(test, gain).otherwise(0.0)
    score = F.least(squares, F.lit(4)) + yes(names_principle(takeaway), 3.0) + yes(method.rlike(ROUTINE), 2.0) + yes(target.rlike(CONTRAST), 1.5) + yes(filled.between(1, 4), 1.0)
    score = score + F.when(off <= 0, 1.5).otherwise(-F.least(off / 40.0, F.lit(3.0))) - yes(repeats >= 4, 2.0) - yes(target.rlike("(?i)run this checklist"), 1.0) - yes(words > 270, 2.0)
    return F.round(score, 3)


def row_elements(target: Column, body: Column, method: Column, takeaway: Column, move: Column) -> dict[str, Column]:
    """The audit's six elements of one row."""
    return {
        "purpose": (F.coalesce(move, F.lit("")) != "") & body.rlike(PURPOSE), "strategic": names_principle(target), "in_takeaway": names_principle(takeaway),
        "squares": F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b([a-h][1-8])\b"), F.lit(1)))) >= 2, "method": F.length(F.coalesce(method, F.lit(""))) > 15,
        "jargon": target.rlike(LEAKS_AUDIT), "words": F.size(F.regexp_extract_all(target, F.lit(r"\S+"), F.lit(0))),
    }


def method_bucket(method: Column) -> Column:
    return F.when(F.length(F.coalesce(method, F.lit(""))) < 20, "stub").when(method.rlike(ROUTINE), "routine").otherwise("narration")


def contradicts(text: Column, best: Column) -> Column:
    """Advises a trade where the best line is already bad."""
    mentions = text.rlike(r"(?i)\b(trade|exchange|simplif)")
    against = text.rlike(r"(?i)\b(avoid|don't|do not|never)\b[^.]{0,30}\b(trade|exchange|simplif)")
    return mentions & (best <= -60) & ~against


def artefacts(text: Column, move: Column) -> dict[str, Column]:
    """Marks of a badly put together target."""
    body = F.regexp_replace(text, r"^I'd play [^.]*\.", "")
    return {
        "dangling": body.rlike(AUDIT_DANGLING), "restated": body.rlike(AUDIT_RESTATED), "repeats": F.size(F.split(text, F.concat(F.lit("\\Q"), move, F.lit("\\E")))) - 1 >= 4,
        "double_space": F.contains(text, F.lit("  ")), "leak": text.rlike(LEAKS_AUDIT), "no_lead": ~F.startswith(text, F.lit("I'd play ")),
    }


def sentences(text: Column) -> Column:
    """Split after . ! ? and blanks, or at newlines; blank ones go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def strip_thinking(text: Column) -> Column:
    """A tagged reasoning span goes; after a closing tag alone only the tail stays."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(out, r"(?is)^.*</think>", ""))


def rating_of_title(title: Column) -> Column:
    """Number with a rating word; the word then a number; the middle of a range; the first bare 600 to 2800; null."""
    number = lambda p: F.nullif(F.regexp_extract(title, p, 1), F.lit("")).cast("int")
    first, second = F.nullif(F.regexp_extract(title, r"\b(\d{3,4})\s*[-–]\s*(\d{3,4})\b", 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract(title, r"\b(\d{3,4})\s*[-–]\s*(\d{3,4})\b", 2), F.lit("")).cast("int")
    bare = F.get(F.filter(F.transform(F.regexp_extract_all(title, F.lit(r"\b(\d{3,4})\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(600, 2800)), F.lit(0))
    return F.coalesce(number(r"(?i)\b(\d{3,4})\+?\s*(?:elo|rated|rating)\b"), number(r"(?i)\b(?:elo|rated|rating)\s*:?\s*(\d{3,4})\b"), F.floor((first + second) / 2).cast("int"), bare)


#: Entities that captions and pages hold; others stay as they are.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def untagged(text: Column) -> Column:
    """Tags go, entities are resolved, blanks squeezed."""
    out = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"\s+", " "))


def section_of(markdown: Column, heading: str) -> Column:
    """Text from the level-two heading that holds `heading` to the next one."""
    return F.regexp_replace(F.regexp_extract(markdown, rf"(?ims)^##[^\n]*{heading}[^\n]*\n(.*?)(?=^## |\z)", 1), r"^\s+|\s+$", "")


def front_matter(markdown: Column) -> tuple[Column, Column]:
    """(header, body); header is null if there is none."""
    header = F.nullif(F.regexp_extract(markdown, r"(?s)^---\n(.*?)\n---\n", 1), F.lit(""))
    return header, F.regexp_replace(markdown, r"(?s)^---\n.*?\n---\n", "")


def filled(template: str, values: dict[str, Column], empty: str = "(none provided)") -> Column:
    """The template with {name} placeholders replaced; null and empty values become the default."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.nullif(value, F.lit("")), F.lit(empty)))
    return out


def swapped_token(text: Column, old: Column, new: Column) -> Column:
    """Every whole token `old` becomes `new`; letters, digits, + # = - beside it guard it."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?<![\w+#=\-])\Q"), old, F.lit(r"\E(?![\w+#=\-])")), F.regexp_replace(new, r"([\\$])", r"\\$1"))


def rendered_prompt(level: Column, low: Column, high: Column, board: Column, side: Column, pool: Column, human: Column, cap: Column) -> Column:
    """The prompt of one scenario from its nested arrays: pool rows, then the first six of the human policy in percent."""
    rows = F.array_join(F.transform(pool, lambda m: F.format_string("  - %s (eval %scp) idea: %s", m["san"], m["cp"].cast("string"), F.array_join(F.slice(m["pv"], 1, 3), " "))), "\n")
    likely = F.array_join(F.transform(F.slice(human, 1, 6), lambda m: F.format_string("  - %s: %s%%", m["san"], F.bround(m["policy"] * 100, 0).cast("int").cast("string"))), "\n")
    return F.concat_ws("\n", F.format_string("Student rating tier: %s (%s-%s).", level, low.cast("string"), high.cast("string")), F.concat(F.lit("Board:\n"), board), F.concat(side, F.lit(" to move.")), F.lit("Engine-sound candidate moves [internal reference — never quote these numbers]:"), rows, F.lit("Human-likelihood at this tier (Maia):"), likely, F.concat(F.lit("\nRecommend exactly ONE move from the sound list. Ply cap: "), cap.cast("string"), F.lit(".")))


def parsed_prompt(prompt: Column) -> dict[str, Column]:
    """Level, pool names and policy names read back from a prompt."""
    return {
        "level": F.regexp_extract(prompt, r"rating tier: (\w+)", 1), "side": F.regexp_extract(prompt, r"(White|Black) to move", 1),
        "pool": F.regexp_extract_all(prompt, F.lit(r"  - (\S+) \(eval"), F.lit(1)), "human": F.regexp_extract_all(prompt, F.lit(r"  - (\S+): \d+%"), F.lit(1)),
    }


def short_rows(rows: DataFrame, board: Column, side: Column) -> DataFrame:
    """Rows (level, fen, san, uci, student, phase, action) whose provenance is complete, with user and target of a short
    answer without an engine's data: the position and what was played; the move, one sentence, and the phase's advice."""
    known = F.coalesce(F.col("fen") != "", F.lit(False)) & F.col("level").isin(*LEVELS) & F.coalesce(F.col("san") != "", F.lit(False)) & F.coalesce(F.col("uci") != "", F.lit(False))
    student = F.nullif("student", F.lit(""))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in LEVEL_RATINGS.items() for x in (k, str(v[i]))]), F.col("level"))
    advice = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PHASE_ADVICE.items() for x in kv]), F.coalesce("phase", F.lit("middlegame"))), F.lit(OTHER_ADVICE))
    lead = F.when((F.coalesce("action", F.lit("")) == "endorse") | F.coalesce(student == F.col("san"), F.lit(False)), F.concat("san", F.lit(" is a sound, level-appropriate choice here.")))
    lead = lead.when(student.isNotNull(), F.concat("san", F.lit(" is a clearer and sounder try than "), student, F.lit("."))).otherwise(F.concat("san", F.lit(" keeps your position solid and is easy to follow at your level.")))
    ask = filled(SHORT_ASK, {"level": F.col("level"), "why": F.when(student.isNotNull(), ", and coach them on why it is a better choice.").otherwise("."), "plies": of(2)})
    head = F.concat(F.lit("Student rating tier: "), F.col("level"), F.lit(" ("), of(0), F.lit("-"), of(1), F.lit(")."))
    user = F.concat_ws("\n", head, F.concat(F.lit("FEN: "), F.col("fen")), F.concat(F.lit("Board:\n"), board), F.concat(side, F.lit(" to move.")), F.concat(F.lit("The student played "), student, F.lit(".")), F.lit(""), ask, F.lit(""), F.lit(SHORT_FORM))
    target = F.concat(F.lit("I'd play "), F.col("san"), F.lit(". "), lead, F.lit(" Takeaway: When you are unsure, "), advice, F.lit("."))
    return rows.where(known).withColumn("user", user).withColumn("target", target)


def chat_row(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", system), ("user", user), ("assistant", assistant))])


def words_of(text: Column) -> Column:
    """Words between blanks. Give it a column of its own before a lambda reads it, or each call splits the text again."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def even_chunks(words: Column, words_per_chunk: int, most: int, between: str = "\n...\n") -> Column:
    """Windows of an array of words; of more than `most`, those at evenly spaced places, joined."""
    n = F.ceil(F.size(words) / words_per_chunk).cast("int")
    all_ = F.sequence(F.lit(0), n - 1)
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (n - 1) / F.lit(float(most - 1)), 0).cast("int")))
    places = F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, all_).otherwise(some)
    return F.array_join(F.transform(places, lambda p: F.array_join(F.slice(words, p * words_per_chunk + 1, words_per_chunk), " ")), between)
