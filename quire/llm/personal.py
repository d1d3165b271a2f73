"""Personal data by candidates and boosted trees, beside fixed rules; SQL functions only.

The base rules always hold. Generators of high recall propose further spans, which may overlap: addresses spelt out,
telephone numbers without a plus, numbers of persons and accounts, network addresses. Each candidate becomes a short
vector of whole numbers that tell its form (digits, groups, separators, check digits) and its context (words of warning
or of welcome before it, the characters at its ends). Boosted regression trees on logistic loss give it a score; those
over their kind's threshold are spans too. The thresholds are the least scores that keep the precision asked for on a
held-out fold. Samples are counted by vector on the executors, and the trees grow from that short table; as literals in
the plan they score every candidate where its text stands. Nothing is shuffled in a scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import spans as sp

KINDS = ("email", "ip", "card", "phone", "mail", "tel", "person", "account", "net")
BASE = 4
# The base rules, in the order of their kinds. Runs are taken whole (possessive), so that a text is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_OK = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

#: The generators, one for each kind after the base ones, and the characters of context on either side.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:\x20?[\[({<]\x20?(?i:at|@)\x20?[\])}>]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({<]\x20?(?i:dot|\.)\x20?[\])}>]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z+.,-])\(?[0-9]{2,8}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.-])(?:[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}|[0-9]{9})(?![0-9A-Za-z-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}[:-]){2,7}+[:]?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+(?![0-9A-Za-z:])",
)
#: What a text with an address spelt out has.
SPELT = r"(?i)[\[({<\x20](?:at|@)[\x20\])}>]"
#: Of overlapping spans of the trees, that of the kind named first here stays.
ORDER = ("account", "net", "person", "tel", "mail")
CONTEXT = 24
WELCOME = r"(?i)(?:tel|phone|call|fax|mobile|cell|dial|text me|ssn|social|social security|tax id|passport|iban|account|acct|bank|mail|contact|reach|write to|ipv6|mac|host|born|birth)[^a-z0-9]{0,8}(?:(?:no|nr|number|is|at|me|us|me at|us at|address)[^a-z0-9]{1,4}){0,2}$"
WARNING = r"(?i)(?:isbn|issn|order|invoice|version|release|page|pages|fig|figure|item|part|sku|ref|model|ticket|date|dated|time|price|total|section|chapter|table|serial|batch|lot|room|vol|doi|score|ratio|code)[^a-z]{0,8}$"
DATE = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2}|(?:1[5-9]|20)[0-9]{2}[- /]{1,2}(?:1[5-9]|20)?[0-9]{2})$"
#: Numbers in a vector; its names are for reading only.
FEATURES = ("kind", "digits", "groups", "separator", "brackets", "welcome", "warning", "left", "right", "check", "first", "last", "date")

#: Trees, their rate, penalty and depth; least precision on the held-out fold, and least score whatever that says.
TREES, RATE, PENALTY, DEPTH = 32, 0.3, 1.0, 3
PRECISION, LEAST_SCORE = 0.995, 0.6
#: Samples that are generated, documents whose candidates are taken as ordinary, different vectors that come to the driver.
FIT_SAMPLES, FIT_DOCS, MAX_VECTORS = 12_000, 2_000, 20_000

# What samples are made of: # stands for any digit. Of accounts and network addresses, examples that their standards give.
PERSONAL = (
    ("tel", ("Tel. ", "phone: ", "call me at ", "Fax ", "mobile ", "my cell is ", "contact: ", "Please dial ", ""), ("(###) 555-####", "###-555-####", "###.555.####", "0### ######", "(0###) ## ## ##", "0# ## ## ## ##", "### 555 ####", "0###/#######")),
    ("person", ("SSN ", "ssn: ", "social security number ", "tax id ", "passport ", "Social: ", ""), ("###-##-####", "### ## ####", "###-##-####", "#########")),
    ("account", ("IBAN ", "iban: ", "account no. ", "bank account ", "pay to ", ""), ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "NL91ABNA0417164300", "ES9121000418450200051332")),
    ("net", ("IPv6 ", "host ", "MAC ", "from ", "address "), ("2001:db8:85a3:#:#:8a2e:370:7334", "fe80:#:#:#:####:#aff:fe#c:#", "00:1B:##:##:3A:B7", "00-1B-44-11-3A-B#", "2001:db8::#:####")),
    ("mail", ("mail ", "contact: ", "write to ", "reach me at ", "e-mail: ", ""), ("jane.doe (at) example (dot) org", "john## [at] example [dot] com", "info(at)example.org", "k.lee at example dot net", "sales {at} example {dot} co {dot} uk", "j_smith## [at] example.com")),
)
ORDINARY = (
    (("ISBN ", "isbn: "), ("#78-#-##-######-#", "#-###-#####-#", "#78 # ## ###### #")), (("order ", "Invoice no. ", "ticket ", "Ref: ", "part no. ", "item "), ("###-####", "####-###-##", "#########", "##-####-####", "###-##-####")),
    (("on ", "date: ", "dated ", "Released ", "since ", "", "("), ("20##-0#-1#", "1#.0#.200#", "#/1#/201#", "0#/0#/##", "1###-200#", "1###/2000", "1###-##")), (("at ", "time ", "from ", ""), ("1#:2#:3#", "0#:1#:5#", "1:2#:3#")),
    (("version ", "v", "release ", "section ", "Figure ", "pages ", "chapter "), ("#.##.###", "##.##", "###-###", "##.##.##", "10.##.#", "1##-20#")), (("$", "total ", "price ", "EUR ", "about ", ""), ("## ###", "### ### ###", "###.###.###", "##.##", "## ###.##")),
    (("of ", "with ", "the ", "and "), ("## ### of", "## ##", "### ###", "## ## ## ##", "12 34 56 78 #0", "200# 2010 2011", "#########")), (("ratio ", "score ", "was "), ("##:##:##", "##-##", "#:##:##", "a:b:c")),
    (("code ", "model ", "serial ", "batch "), ("AB## #### ##AA", "XY##ABCD####", "QT## ABCD EFGH", "ZZ## #### #### ####", "###-##-####-#")), (("look ", "we met ", "he was ", "they stood "), ("there at noon.They", "late at night.She", "up at home.It", "one at random.The", "down at last.He")),
)


def luhn(digits: str) -> str:
    """Whether the check digit of a string of digits is right, as SQL."""
    value = f"(ascii(substring({digits}, length({digits}) - i, 1)) - 48)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {value}, if({value} > 4, 2 * {value} - 9, 2 * {value}))) % 10 = 0"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def base_spans(text: str) -> str:
    """Spans of the base rules by start, then kind, as SQL. Short runs of digits can't be a card, so its least number of
    digits stands in the pattern; other matches that fail use up their text."""
    some = f"{text} RLIKE '[0-9]'"
    between = lambda x, bounds: f"length({x}) BETWEEN {bounds[0]} AND {bounds[1]}"
    rules = (
        sp.hits(text, EMAIL, 0, guard=f"contains({text}, '@')"),
        sp.hits(text, IP, 1, lambda m: f"{m} RLIKE {sp.quoted(IP_OK)}", some),
        sp.hits(text, CARD, 2, lambda m: sp.let(_digits(m), lambda d: f"{between(d, CARD_DIGITS)} AND {luhn(d)}"), some),
        sp.hits(text, PHONE, 3, lambda m: between(_digits(m), PHONE_DIGITS), f"contains({text}, '+')"),
    )
    return f"sort_array(concat({', '.join(rules)}))"


def candidates(text: str) -> str:
    """Spans that the generators propose, with their matches and contexts, as SQL."""
    some = f"{text} RLIKE '[0-9]'"
    ok = {"tel": lambda m: f"length({_digits(m)}) BETWEEN 6 AND 15"}
    guard = {"mail": f"{text} RLIKE {sp.quoted(SPELT)}", "net": f"(contains({text}, ':') OR contains({text}, '-'))"}
    rules = [sp.hits(text, p, k, ok.get(KINDS[k], lambda m: "true"), guard.get(KINDS[k], some), CONTEXT) for k, p in enumerate(GENERATORS, BASE)]
    return f"concat({', '.join(rules)})"


def _check(hit: str) -> str:
    """2 for an account number whose remainder by 97 is right, 1 for one whose is not, else 0."""
    digit = "ascii(c) < 58"
    rest = lambda p: (
        f"aggregate(filter(split(concat(substring({p}, 5), substring({p}, 1, 4)), ''), c -> c != ''), 0, (a, c) -> (a * if({digit}, 10, 100) + ascii(c) - if({digit}, 48, 55)) % 97)"
    )
    return sp.let(f"replace({hit}, ' ')", lambda p: f"CASE WHEN {p} NOT RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' THEN 0 WHEN {rest(p)} = 1 THEN 2 ELSE 1 END")


def features(c: str) -> str:
    """Vector of a candidate, as SQL."""
    left, right = f"substring({c}.before, -1, 1)", f"substring({c}.after, 1, 1)"
    kinds = lambda x, *classes: "CASE " + " ".join(f"WHEN {x} RLIKE {sp.quoted(p)} THEN {k}" for k, p in enumerate(classes)) + f" ELSE {len(classes)} END"
    seps = lambda s: f"CASE size({s}) WHEN 0 THEN 0 WHEN 1 THEN instr('- ./:', get({s}, 0)) ELSE 6 END"
    size = lambda g, i: f"least(coalesce(length(get({g}, {i})), 0), 9)"
    is_so = lambda x, pattern: f"cast({x} RLIKE {sp.quoted(pattern)} AS int)"
    return sp.let(
        f"filter(split({c}.hit, '[^0-9]+'), x -> x != '')",
        lambda g: "array(" + ", ".join((
            f"{c}.kind", f"least(length({_digits(f'{c}.hit')}), 20)", f"least(size({g}), 9)", sp.let(f"array_distinct(regexp_extract_all({c}.hit, '[ ./:-]', 0))", seps), is_so(f"{c}.hit", r"[\[({]"),
            is_so(f"{c}.before", WELCOME), is_so(f"{c}.before", WARNING), kinds(left, r"^\s?$", "[A-Za-z0-9_]", r"\p{Sc}", r"[\"'(\[]", "[:=]", "[-/.,]"), kinds(right, r"^\s?$", "[.,;:!?]", "[A-Za-z0-9_]", r"[%\p{Sc}]"),
            _check(f"{c}.hit"), size(g, "0"), size(g, f"size({g}) - 1"), is_so(f"{c}.hit", DATE),
        )) + ")",
    )


@dataclass(frozen=True)
class Model:
    """Trees of depth 3 as rows of 7 tests (feature, bound: left where the value is at most the bound) and 8 leaves, and the
    threshold of each kind after the base ones."""

    prior: float
    trees: tuple[tuple[tuple[tuple[int, int], ...], tuple[float, ...]], ...]
    thresholds: tuple[float, ...] = field(default=(LEAST_SCORE,) * len(GENERATORS))


def _grow(rows: list[tuple[tuple[int, ...], float, float]]) -> tuple[tuple[tuple[int, int], ...], tuple[float, ...]]:
    """One tree on rows (vector, gradient, curvature), level by level, by the histograms of every feature."""
    width = len(FEATURES)

    def best(part: list) -> tuple[int, int]:
        g0, h0 = sum(r[1] for r in part), sum(r[2] for r in part)
        top, test = 1e-9, (0, 1 << 20)
        for f in range(width):
            sums: dict[int, list[float]] = {}
            for x, g, h in part:
                s = sums.setdefault(x[f], [0.0, 0.0])
                s[0] += g
                s[1] += h
            gl = hl = 0.0
            for v in sorted(sums)[:-1]:
                gl, hl = gl + sums[v][0], hl + sums[v][1]
                gain = gl * gl / (hl + PENALTY) + (g0 - gl) ** 2 / (h0 - hl + PENALTY) - g0 * g0 / (h0 + PENALTY)
                if gain > top:
                    top, test = gain, (f, v)
        return test

    level, tests = [rows], []
    for _ in range(DEPTH):
        nxt = []
        for part in level:
            f, v = best(part)
            tests.append((f, v))
            nxt += [[r for r in part if r[0][f] <= v], [r for r in part if r[0][f] > v]]
        level = nxt
    leaf = lambda part: RATE * sum(r[1] for r in part) / (sum(r[2] for r in part) + PENALTY)
    return tuple(tests), tuple(leaf(p) for p in level)


def leaf_of(x: tuple[int, ...], tests: tuple[tuple[int, int], ...]) -> int:
    """Number of the leaf that a vector falls in; tests stand level by level."""
    at = 0
    for _ in range(DEPTH):
        f, v = tests[at]
        at = 2 * at + (1 if x[f] <= v else 2)
    return at - (2**DEPTH - 1)


def boost(rows: list[tuple[tuple[int, ...], int, int, int, int]]) -> Model:
    """Model from rows (vector, personal, ordinary, and both of the held-out fold): counts of samples by vector."""
    kept = [(x, p, n) for x, p, n, _, _ in rows if p + n]
    p, n = sum(r[1] for r in kept), sum(r[2] for r in kept)
    prior = math.log((p + 1) / (n + 1))
    scores, trees = [prior] * len(kept), []
    for _ in range(TREES if p and n else 0):
        grads = []
        for (x, a, b), s in zip(kept, scores, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append((x, a * (1 - q) - b * q, (a + b) * q * (1 - q)))
        tests, leaves = _grow(grads)
        trees.append((tests, leaves))
        scores = [s + leaves[leaf_of(r[0], tests)] for s, r in zip(scores, kept, strict=True)]
    model = Model(prior, tuple(trees))
    held = [(x[0], plain_score(x, model), p, n) for x, _, _, p, n in rows if p + n]
    return Model(prior, model.trees, tuple(_threshold([r[1:] for r in held if r[0] == k]) for k in range(BASE, len(KINDS))))


def _threshold(held: list[tuple[float, int, int]]) -> float:
    """Least score from which on the held-out fold is as precise as asked for; 2, which no score reaches, if none is."""
    best, p, n = 2.0, 0, 0
    for s, a, b in sorted(held, reverse=True):
        p, n = p + a, n + b
        if p and p >= PRECISION * (p + n):
            best = s
    return max(best, LEAST_SCORE)


def plain_score(x: tuple[int, ...], model: Model) -> float:
    """Score of one vector, as ``scored`` has it."""
    return 1 / (1 + math.exp(-(model.prior + sum(round(leaves[leaf_of(x, tests)], 6) for tests, leaves in model.trees))))


def scored(x: str, model: Model) -> str:
    """Score, 0 to 1, of a vector, as SQL: the trees are one literal."""
    ints = lambda v: f"array({','.join(map(str, v))})"
    row = lambda t, leaves: f"struct({ints(f for f, _ in t)} AS f, {ints(v for _, v in t)} AS v, array({','.join(f'{a:.6f}D' for a in leaves)}) AS leaf)"
    if not model.trees:
        return f"{1 / (1 + math.exp(-model.prior))}D"
    trees = f"array({', '.join(row(*t) for t in model.trees)})"
    walk = f"aggregate(array({','.join(map(str, range(DEPTH)))}), 0, (p, q) -> 2 * p + if(get({x}, get(t.f, p)) <= get(t.v, p), 1, 2))"
    return f"1 / (1 + exp(-aggregate({trees}, {model.prior!r}D, (s, t) -> s + get(t.leaf, {walk} - {2**DEPTH - 1}))))"


def generated(spark: SparkSession, samples: int = FIT_SAMPLES) -> DataFrame:
    """(text, personal): sentences with one sample each; digits and the choice of parts follow from a hash of a counter."""
    quoted = lambda xs: "array(" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
    pairs = [(1, cues, forms) for _, cues, forms in PERSONAL] + [(0, cues, forms) for cues, forms in ORDINARY]
    table = "array(" + ",".join(f"named_struct('y',{y},'cues',{quoted(c)},'forms',{quoted(f)})" for y, c, f in pairs) + ")"
    pick = lambda xs, salt: F.get(xs, F.pmod(F.xxhash64("id", F.lit(salt)), F.size(xs).cast("bigint")).cast("int"))
    rows = spark.range(0, samples, 1, 4).withColumn("t", pick(F.expr(table), "row")).withColumn("h", F.sha2(F.col("id").cast("string"), 512))
    filled = F.array_join(F.transform(F.split(pick(F.col("t.forms"), "form"), ""), lambda c, i: F.when(c == "#", (F.ascii(F.substring("h", i + 1, F.lit(1))) % 10).cast("string")).otherwise(c)), "")
    lead, trail = F.array(*map(F.lit, ("of the ", "The end. ", "and, ", "or ", "said "))), F.array(*map(F.lit, (" and the", ". The", ", so", " of", "")))
    return rows.select(F.concat(pick(lead, "lead"), pick(F.col("t.cues"), "cue"), filled, pick(trail, "trail")).alias("text"), (F.col("t.y") == 1).alias("personal"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = FIT_SAMPLES, fit_docs: int = FIT_DOCS, max_vectors: int = MAX_VECTORS) -> Model:
    """Model from generated samples and, as ordinary, the candidates of at most ``fit_docs`` documents (first by a hash of
    their id) that no base span touches and no word of welcome precedes. A fifth of all is held out for the thresholds. At
    most ``max_vectors`` different vectors, the first by hash, take part. Null ids and texts teach nothing."""
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(fit_docs).distinct()
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(ids), "_id")  # at most fit_docs numbers
    ordinary = own.select("_text", F.lit(False).alias("personal"), F.expr(candidates("_text")).alias("m"), F.expr(base_spans("_text")).alias("b"))
    ordinary = ordinary.select("_text", "personal", F.expr(sp.apart("m", "b")).alias("c")).where("size(c) > 0")
    made = generated(docs.sparkSession, samples).select(F.col("text").alias("_text"), "personal", F.expr(candidates("text")).alias("c")).where("size(c) > 0")
    # The candidate of a made text is its longest.
    longest = F.array_max(F.transform("c", lambda c: F.struct((c["end"] - c["start"]).alias("n"), c.alias("c"))))["c"]
    rows = made.select("_text", "personal", longest.alias("c")).unionByName(ordinary.select("_text", "personal", F.explode("c").alias("c")).where(~F.col("c.before").rlike(WELCOME)))
    y, held = F.col("personal"), F.pmod(F.xxhash64("_text"), F.lit(5)) == 0
    counts = rows.select(F.expr(features("c")).alias("x"), "personal", held.alias("held")).groupBy("x").agg(
        F.count_if(y & ~F.col("held")), F.count_if(~y & ~F.col("held")), F.count_if(y & F.col("held")), F.count_if(~y & F.col("held"))
    )
    return boost([(tuple(r[0]), *r[1:]) for r in counts.orderBy(F.xxhash64("x"), "x").limit(max_vectors).collect()])


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``spans``: array<struct<start, kind, end>> by start, then kind.

    ``kind`` is an index into ``KINDS``; offsets are code points, the end exclusive. Base spans always stay, and may overlap
    each other; those of the trees touch no other. Null and empty texts have no spans; repeated rows stay, and rows of
    null ids are rows like any other; other columns are left behind.
    """
    steps = ("spans", "_text", "_base", "_more", "_good")
    keep = tuple(c for c in dict.fromkeys([id_col, *keep]) if c not in steps)
    # Each step is a column that the next one names more than once: otherwise it would be worked out within the lambdas.
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select(*keep, F.expr(base_spans("_text")).alias("_base"), F.expr(candidates("_text")).alias("_more"))
    limits = f"array({','.join(f'{t!r}D' for t in model.thresholds)})"
    good = f"filter({sp.apart('_more', '_base')}, c -> {sp.let(features('c'), lambda v: scored(v, model))} >= get({limits}, c.kind - {BASE}))"
    plain = f"transform({good}, c -> struct(c.start AS start, c.kind AS kind, c.`end` AS `end`))"
    rows = rows.select(*keep, F.col("_base").alias("spans"), F.expr(f"CASE WHEN size(_more) = 0 THEN {sp.NO_SPANS} ELSE {plain} END").alias("_good"))
    for kind in map(KINDS.index, ORDER):
        new = sp.apart(f"filter(_good, c -> c.kind = {kind})", "spans")
        rows = rows.select(*keep, F.expr(f"CASE WHEN size(_good) = 0 THEN spans ELSE sort_array(concat(spans, {new})) END").alias("spans"), "_good")
    return rows.select(*keep, "spans")


def joined(spans: str = "spans", base_only: bool = False) -> Column:
    """``kind:start:end`` of each span of a column, comma-joined."""
    return F.expr(sp.joined(spans, KINDS, BASE if base_only else None))


def redacted(text: str = "text", spans: str = "spans", mark: str = "[PERSONAL]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``; a text without spans as it is."""
    return F.expr(sp.redacted(text, spans, mark))
