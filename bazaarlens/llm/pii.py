"""Personal data: overlapping candidate spans, judged by boosted trees with calibrated thresholds. DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import join_sized, written
from bazaarlens.llm.spans import joined, matches

#: Kinds in the order of their reports; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "email_spelt", "phone_local", "id_number")
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Written so that the regex engine neither recurses nor starts anew at each place of a long run; each matches what the plain form does.
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?=\.{_NAME})[A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?(?:[^0-9\x20-]|\z))",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?{_NAME}++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{{2,12}}",
    r"(?<![0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
)
#: Words before a match that speak for its kind (by kind), and words that speak against all kinds.
_MAIL, _CALL = r"\b(?:e-?mails?|mail|contact|write|reach|kontakt\w*|schreib\w*|correo|contacto|escrib\w*|courriel|[eé]criv\w*)\b", r"\b(?:call|phones?|tel|telephone|fax|mobile|cell|ring|contact|reach|text|telefon\w*|anruf\w*|handy|m[oó]vil|tel[eé]fono|llam\w*|t[eé]l[eé]phone|appel\w*|portable)\b"
FOR = (_MAIL, r"\b(?:ip|host|server|addr|address)\b", r"\b(?:card|visa|mastercard|amex|credit|debit|pay|account|iban|karte|konto|tarjeta|cuenta|carte|compte)\b", _CALL, _MAIL, _CALL, r"\b(?:ssn|social|security|id|identity|tax|taxpayer|passport|ausweis|steuer\w*|dni|identidad|identit[eé])\b")
AGAINST = r"\b(?:order|part|sku|isbn|issn|invoice|version|serial|model|item|ref|reference|tracking|ticket|build|page|bestell\w*|pedido|commande)\b"
#: Trees, their depth and learning rate; the share of right candidates that a threshold must reach; the part held back for calibration.
TREES, DEPTH, RATE, PRECISION, HELD = 24, 3, 0.3, 0.95, 5


def _needs(text: Column) -> list[Column]:
    has = lambda x: F.contains(text, F.lit(x))
    return [has("@"), has("."), F.lit(True), has("+"), has("at") & has("dot"), F.lit(True), has("-")]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (rid, id, kind, start, end, valid, value, fit, near, for, against, f0, f1, ...): all matches of all generators, which may overlap.

    ``valid`` is whether a base kind passes its check, and null for the other kinds. ``value`` is a hash of the address
    or number meant, alike for an address and its spelt form, and for a number with a country code and without.
    ``fit`` is whether a match of a further kind keeps to its format: an address with bracketed signs, a number whose
    area and groups are given out. ``near`` is whether a failed base match falls short by little: a card number by its
    check digit, a phone number by one or two digits. The features are small numbers of format (kind, length, digits,
    separators, fit) and context (the characters and words around).
    """
    rows = matches(docs, list(zip(PATTERNS, _needs(F.col("text")), strict=True)))
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    parts = F.split("match", r"\.")
    valid = (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.forall(parts, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)) <= 255))
        .when(F.col("kind") == 2, n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(F.col("kind") == 3, n.between(9, 15))
    )
    group = lambda a, n: F.substring(digits, a, n)
    fit = (
        F.when(F.col("kind") == 4, F.col("match").rlike(r"[(\[](?:at|dot)[)\]]"))
        .when(F.col("kind") == 5, group(1, 1).between("2", "9") & (group(4, 3) != "000") & (group(7, 4) != "0000"))
        .when(F.col("kind") == 6, ~group(1, 3).isin("000", "666") & (group(1, 1) != "9") & (group(4, 2) != "00") & (group(6, 4) != "0000"))
        .otherwise(False)
    )
    near = F.when(F.col("kind") == 2, n.between(13, 19)).when(F.col("kind") == 3, n.between(7, 8)).otherwise(False)
    address = F.regexp_replace(F.regexp_replace(F.lower("match"), r"\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?", "@"), r"\x20?(?:[(\[]dot[)\]]|\x20dot\x20)\x20?", ".")
    value = F.when(F.col("kind").isin(0, 4), F.xxhash64(F.lit(0), address)).when(F.col("kind").isin(3, 5) & (n >= 10), F.xxhash64(F.lit(3), F.right(digits, F.lit(10))))
    speaks = reduce(lambda a, k: a.when(F.col("kind") == k, F.lower("left").rlike(FOR[k])), range(1, len(KINDS)), F.when(F.col("kind") == 0, F.lower("left").rlike(FOR[0])))
    against = F.lower("left").rlike(AGAINST)
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)
    features = [
        F.col("kind"),
        F.when(n < 9, 0).when(n < 13, 1).when(n < 16, 2).when(n == 16, 3).when(n < 20, 4).otherwise(5),
        F.when(F.col("match").contains(" "), 1).otherwise(0) + F.when(F.col("match").contains("-"), 2).otherwise(0),
        F.col("match").contains("(").cast("int"),
        side(F.right("left", F.lit(1))),
        side(F.left("right", F.lit(1))),
        F.coalesce(speaks, F.lit(False)).cast("int") + 2 * F.coalesce(against, F.lit(False)).cast("int"),
        F.when(F.substring(digits, 1, 1) == "0", 1).otherwise(0),
        fit.cast("int"),
    ]
    return rows.select("rid", "id", "kind", "start", "end", valid.alias("valid"), value.alias("value"), fit.alias("fit"), near.alias("near"), speaks.alias("for"), against.alias("against"), *[F.when(F.col("kind").isNotNull(), f.cast("int")).alias(f"f{k}") for k, f in enumerate(features)])


#: Values of each feature of ``candidates``; their product bounds what the trees are fitted on.
LEVELS = (len(KINDS), 6, 4, 2, 5, 5, 4, 2, 2)


def judged(found: DataFrame) -> DataFrame:
    """``found`` with ``label``, whether there is evidence that a candidate is right, and null where there is none to judge.

    Base matches that pass their check are right. A candidate of a further kind is right when its value also stands
    somewhere as a valid base span, or by itself: an address by bracketed signs or by a word before it that speaks for
    mail, a local number by its groups or such a word, an id number by its groups; numbers after a word that speaks
    against (an order, a part) need the word that speaks for them too. A base match that fails its check is right
    when it falls short by little and a word speaks for it. No base span in the same place is needed.
    """
    sure = found.filter("valid and value is not null").select("value").distinct()
    known = found.filter("kind > 3 and value is not null").select("value").distinct().join(sure, "value").withColumn("known", F.lit(True))
    rows = join_sized(found, written(known, "pii-known"), "value", "left")
    says = F.col("for") | (F.col("fit") & ~F.col("against"))
    more = F.when(F.col("kind") == 6, F.col("fit") & says).otherwise(says)
    label = F.when(F.col("kind") <= 3, F.col("valid") | (F.col("near") & F.col("for"))).otherwise(F.coalesce("known", F.lit(False)) | more)
    return rows.withColumn("label", label)


def labelled(found: DataFrame) -> DataFrame:
    """Counts of judged candidates by features: rows (f0.., held, base, label, n), at most the product of LEVELS times eight."""
    names = [f"f{k}" for k in range(len(LEVELS))]
    base = F.coalesce("valid", F.lit(False)).alias("base")
    return found.filter("kind is not null").groupBy(*names, (F.pmod(F.xxhash64("rid"), F.lit(HELD)) == 0).alias("held"), base, "label").agg(F.count("*").alias("n"))


def selection(found: DataFrame, precision: float = PRECISION) -> tuple[tuple[float, list], dict[int, float]]:
    """The trees, fitted on four fifths of the judged candidates, and the thresholds by kind.

    Thresholds are set on what they decide: valid base spans, which are reported anyway, do not count.
    """
    counted = [(tuple(r[f"f{k}"] for k in range(len(LEVELS))), int(bool(r.label)), float(r.n), r.held, r.base) for r in labelled(found).collect()]
    model = boost([x[:3] for x in counted if not x[3]])
    return model, thresholds(model, [x[:3] for x in counted if x[3] and not x[4]], precision)


def boost(rows: list[tuple[tuple[int, ...], int, float]], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Gradient-boosted trees for weighted rows (features, label, weight): (start, trees).

    A tree is a leaf (a number) or (feature, level, tree where feature <= level, tree elsewhere). Splits and leaves are
    those of second-order boosting of the logistic loss with a ridge of 1.
    """
    total = sum(w for _, _, w in rows)
    right = sum(w for _, y, w in rows if y)
    start = math.log((right + 0.5) / (total - right + 0.5))
    score, out = [start] * len(rows), []

    def grow(held: list[int], left: int):
        g = sum(grad[i] for i in held)
        h = sum(hess[i] for i in held)
        best = (1e-6, None)
        for f in range(len(rows[0][0])) if left else ():
            sums: dict[int, list[float]] = {}
            for i in held:
                s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            a = b = 0.0
            for level in sorted(sums)[:-1]:
                a, b = a + sums[level][0], b + sums[level][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, level))
        if best[1] is None:
            leaf = rate * g / (h + 1)
            for i in held:
                score[i] += leaf
            return leaf
        f, level = best[1]
        return f, level, grow([i for i in held if rows[i][0][f] <= level], left - 1), grow([i for i in held if rows[i][0][f] > level], left - 1)

    for _ in range(trees if rows else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        grad = [w * (y - q) for (_, y, w), q in zip(rows, p, strict=True)]
        hess = [w * q * (1 - q) for (_, _, w), q in zip(rows, p, strict=True)]
        out.append(grow(list(range(len(rows))), depth))
    return start, out


def walk(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def thresholds(model: tuple[float, list], rows: list[tuple[tuple[int, ...], int, float]], precision: float = PRECISION) -> dict[int, float]:
    """By kind, the least score above which held-back candidates are right at ``precision``; infinite where none is."""
    out = {}
    for kind in range(len(KINDS)):
        own = sorted(((model[0] + sum(walk(t, x) for t in model[1]), y, w) for x, y, w in rows if x[0] == kind), reverse=True)
        good = n = 0.0
        out[kind] = math.inf
        for k, (s, y, w) in enumerate(own):
            good, n = good + y * w, n + w
            if (k + 1 == len(own) or own[k + 1][0] < s) and (good + 0.5) / (n + 1) >= precision:
                out[kind] = s
    return out


def scored(model: tuple[float, list]) -> Column:
    """The model's score as a column of the features."""

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.col(f"f{tree[0]}") <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    return reduce(lambda a, t: a + column(t), model[1], F.lit(float(model[0])))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per input row: id, spans (array of kind, start, name, end, base, score), in order of kind, then start.

    Base spans are matches of the four base kinds that pass their check; they are always reported. Every other
    candidate, a failed base match among them, is scored by trees that are fitted on all candidates of the corpus,
    counted by their features (so the driver sees a bounded table), and is added when its score reaches the
    threshold of its kind. Thresholds are set on held-back candidates so that ``precision`` of those above are right.
    Of a kind without such a threshold, as in a small corpus, the candidates that the evidence calls right are added.

    Offsets are in code points, ends exclusive. Null texts are empty. Rows that repeat an id, and null ids, are
    scanned and reported row by row. An empty table gives an empty result. Extra columns are ignored.
    """
    found = judged(written(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "pii"))
    model, cut = selection(found, precision)
    at = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(cut[k])), range(1, len(KINDS)), F.when(F.col("kind") == 0, F.lit(cut[0])))
    base = F.coalesce(F.col("valid"), F.lit(False))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    rows = found.withColumn("score", F.when(F.col("kind").isNotNull(), scored(model)))
    one = F.struct("kind", "start", F.when(F.col("kind").isNotNull(), name).alias("name"), "end", base.alias("base"), "score")
    shown = F.col("kind").isNotNull() & (base | (F.col("score") >= at) | ((at == math.inf) & F.col("label")))
    out = rows.groupBy("rid", "id").agg(F.array_sort(F.collect_list(F.when(shown, one))).alias("spans"))
    return out.select(F.col("id").alias(id_col), "spans")


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text) with each reported span as ``<kind>``; of overlapping spans the first wins. Needs unique ids."""
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["name"])))
    state = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring("text", a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit("<"), x["name"], F.lit(">")).alias("out"))),
    )
    both = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(spans, id_col).withColumn("state", state)
    return both.select(id_col, F.concat("state.out", F.substring("text", F.col("state.at").cast("int") + 1, F.char_length("text"))).alias("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["base"])
    return rows.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
