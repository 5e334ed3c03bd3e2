r"""PII: candidate spans scored by gradient-boosted trees, all in DataFrame functions.

* **Base spans** follow fixed patterns and checks (e-mail, IP, card, phone).
  They are always redacted.
* **Generators** propose further, overlapping spans with wider patterns:
  bracketed ``at``/``dot``, bracketed IP dots, 16-digit groups and phone shapes
  wherever they stand, also inside a match that failed a base check.
  A candidate that fails its kind's own check (Luhn, octets, digits) is none.
* **Features** of a candidate are small integers of its format (digits, signs,
  blanks, groups) and context (neighbouring characters, cue words before it); the
  check is not among them.  There are no labels, so they come from the table: a
  candidate that is a base span is personal data; an e-mail or phone shape beside them
  without any cue, sign, bracket or disguise is none; the rest are unlabelled and only
  scored.
  Every positive also gives *variants* of itself with a known answer (``VARIANTS``):
  disguised or announced forms stay personal data, the same signs spread like prose,
  glued to an identifier or without any cue are none.
* **Boosted trees** (``DEPTH`` levels, logistic loss) are grown from histograms that
  Spark aggregates; the driver sees one row for each feature value and leaf.  At most
  ``MAX_TRAIN`` labelled candidates (smallest hashes) are used.  A fifth of them
  is kept to calibrate one threshold a kind: the least score down to which at least
  ``PRECISION`` of the kept candidates are positive.
* The finished trees are one SQL expression, so scoring a document is a map
  over its candidate array: no shuffle, no Python, any number of spans.

Positions are code points, end exclusive: the text is split by the pattern and
the lengths of gaps and matches are summed up in blocks, context is read from the
gaps, overlaps are looked up in blocks of sorted spans and texts are cut by blocks of
characters, so that a text with very many spans doesn't take quadratic work.

Defined cases: a null or empty text has no spans; repeated rows each get their
own result; with no labelled candidates nothing is added to the base spans;
input columns are kept, result columns replace columns of the same name; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.llm.graph import stored

#: Kinds in the order that breaks ties of the start.
KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN, TREES, DEPTH, RATE, PRECISION, SMOOTH = 50_000, 10, 3, 0.6, 0.99, 1.0

# Fixed patterns of the base spans.  `\G` and the look-behinds keep the leftmost
# matches of the plain patterns and stop the search from starting inside a run.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Wider patterns of the generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# What a text must hold for a kind's patterns to be worth a search.
_NEED = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
# Cue words that announce a kind.
_CUES = {"email": r"(?i)(e-?mail|contact|write to|reach)", "ip": r"(?i)(\bip\b|host|server|address)",
         "card": r"(?i)(card|visa|master|credit|payment)", "phone": r"(?i)(\btel\b|phone|\bcall\b|mobile|\bfax\b)"}
FEATURES = ("kind", "digits", "letters", "signs", "blanks", "length", "plus", "paren", "bracket", "before", "after", "cue")
# Forms of a positive with a known answer: (is personal data, the features that change).
# Neighbours: 1 a blank, 3 a letter, 5 another sign.
VARIANTS = {
    "email": [(0, {"blanks": 1, "cue": 0}), (0, {"blanks": 2, "cue": 0}), (0, {"blanks": 3, "cue": 0}), (0, {"blanks": 2, "cue": 1}),
              (1, {"blanks": 0, "bracket": 1}), (1, {"blanks": 4, "bracket": 1}), (1, {"blanks": 0, "paren": 1}), (1, {"blanks": 4, "paren": 1})],
    "ip": [(1, {"bracket": 1}), (1, {"paren": 1}), (0, {"before": 3, "cue": 0}), (0, {"before": 5, "cue": 0})],
    "card": [(0, {"before": 3, "cue": 0}), (0, {"before": 5, "cue": 0}), (0, {"after": 3, "cue": 0}), (0, {"after": 5, "cue": 0})],
    "phone": [(y, {"plus": 0, "paren": 0, "digits": 10, "length": 3, "signs": 2, "blanks": blanks, **change})
              for blanks in (0, 1, 2) for y, change in ((0, {"cue": 0}), (0, {"cue": 0, "after": 0}), (0, {"cue": 0, "after": 3}), (0, {"cue": 0, "before": 5}), (1, {"cue": 1}), (1, {"cue": 1, "after": 0}))]
             + [(1, {"plus": 0, "paren": 1, "digits": 10, "length": 3, "signs": signs, "blanks": signs - 3, "cue": cue}) for signs in (3, 4) for cue in (0, 1)],
}
#: Kinds whose check says little: only their undecorated candidates count as negatives.
LOOSE = ("email", "phone")
#: Spans or characters of a block.
BLOCK, CUT = 256, 1024
_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\D+0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _blocks(items: Column, block: int) -> Column:
    """An array cut into arrays of ``block`` items; null for an empty one."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block))))


def _once(value: Column, body) -> Column:
    """``body(value)``, the value computed once a row: a column read in a lambda alone would be put into it and computed for every item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join, block: int) -> Column:
    """Inclusive running result of ``join`` over an array of ints that aren't negative, in blocks so that the work stays linear in practice."""
    put = lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x)))
    none = F.array().cast("array<int>")
    within = F.transform(_blocks(values, block), lambda p: F.aggregate(p, none, put))
    ends = F.aggregate(F.transform(within, lambda w: F.element_at(w, -1)), none, put)
    shifted = F.zip_with(within, F.concat(F.array(F.lit(0)), ends), lambda w, o: F.transform(w, lambda x: join(x, o)))
    return F.coalesce(F.flatten(F.filter(shifted, lambda w: w.isNotNull())), none)


def running_sums(lengths: Column, block: int = BLOCK) -> Column:
    """Inclusive running sums of an int array."""
    return _running(lengths, lambda a, x: a + x, block)


def _luhn(digits: Column) -> Column:
    """Luhn's check of a short digit string."""
    back = F.reverse(digits)
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(back, i, F.lit(1)).cast("int").alias("d")))
    value = lambda x: F.when(x["i"] % 2 == 1, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0))
    return F.aggregate(at, F.lit(0), lambda s, x: s + value(x)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The check of a match of this kind."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _found(df: DataFrame, patterns: dict[str, str], prefix: str, context: bool = False) -> DataFrame:
    """Adds, for each kind, the array ``<prefix>_<kind>`` of structs (start, end, m; left, right with ``context``) of its matches."""
    for kind, pattern in patterns.items():
        gate = F.col("_t").rlike(_NEED[kind])
        df = df.withColumn("_m", F.when(gate, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))))
        df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
        gaps = F.transform(F.slice("_s", F.lit(1), F.size("_m")), lambda x: F.length(x))
        df = df.withColumn("_e", F.when(F.size("_m") > 0, running_sums(F.zip_with(gaps, "_m", lambda g, m: g + F.length(m)))))

        def span(e: Column, i: Column) -> Column:
            m, gap, follows = F.get("_m", i), F.get("_s", i), F.get("_s", i + 1)
            # up to 24 characters before and 1 after the match, back to its neighbour of the same kind
            near = [F.when(gap != "", F.right(gap, F.lit(24))).when(i > 0, F.right(F.get("_m", i - 1), F.lit(1))).otherwise("").alias("left"),
                    F.when(follows != "", F.left(follows, F.lit(1))).otherwise(F.left(F.coalesce(F.get("_m", i + 1), F.lit("")), F.lit(1))).alias("right")] if context else []
            return F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m"), *near)

        kind_of = "array<struct<start:int,end:int,m:string" + (",left:string,right:string>>" if context else ">>")
        df = df.withColumn(f"{prefix}_{kind}", F.coalesce(F.transform("_e", span), F.array().cast(kind_of))).drop("_m", "_s", "_e")
    return df


def _features(kind: str, x: Column) -> dict[str, Column]:
    m, right = x["m"], x["right"]
    left = F.right(x["left"], F.lit(1))
    count = lambda keep: F.length(F.regexp_replace(m, keep, ""))
    sort = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[A-Za-z]"), 3).when(c.rlike("[.,;:!?)\"']"), 4).otherwise(5)
    return {
        "kind": F.lit(KINDS.index(kind)), "digits": F.least(count("[^0-9]"), F.lit(24)), "letters": F.least(count("[^A-Za-z]"), F.lit(24)),
        "signs": F.least(count("[A-Za-z0-9]"), F.lit(12)), "blanks": F.least(count("[^ ]"), F.lit(4)), "length": F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(16)),
        "plus": m.startswith("+").cast("int"), "paren": m.contains("(").cast("int"), "bracket": m.contains("[").cast("int"),
        "before": sort(left), "after": sort(right), "cue": x["left"].rlike(_CUES[kind]).cast("int"),
    }


def _in_blocks(spans: Column) -> Column:
    """Sorted spans in blocks (lo, hi, spans), for ``_meets``."""
    return F.transform(_blocks(spans, BLOCK), lambda p: F.struct(F.element_at(p, 1)["start"].alias("lo"), F.array_max(F.transform(p, lambda y: y["end"])).alias("hi"), p.alias("spans")))


def _meets(x: Column, blocks: Column, also=None) -> Column:
    """Whether a span of the blocks overlaps ``x`` (and fulfils ``also``)."""
    touch = lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    return F.coalesce(F.exists(blocks, lambda b: (b["lo"] < x["end"]) & (x["start"] < b["hi"])
                               & F.exists(b["spans"], lambda y: touch(y) if also is None else touch(y) & also(y))), F.lit(False))


def _with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_base`` (start, kind, end) and ``_cands`` (start, kind, end, y, features) to every row."""
    df = df.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = _found(_found(df, BASE, "_b"), WIDE, "_w", context=True)
    def sound(kind: str) -> Column:
        kept = F.filter(f"_b_{kind}", lambda x: _passes(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    for kind in KINDS:
        df = df.withColumn(f"_b_{kind}", sound(kind))
    df = df.withColumn("_base", F.array_sort(F.concat(*[f"_b_{k}" for k in KINDS])))
    df = df.withColumn("_blocks", _in_blocks(F.col("_base")))

    def rows(kind: str) -> Column:
        def one(x: Column) -> Column:
            f = _features(kind, x)
            plain = F.lit(kind in LOOSE) & ((f["plus"] + f["paren"] + f["bracket"] + f["cue"]) == 0)
            same = lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]) & (y["kind"] == KINDS.index(kind))
            touches = _meets(x, F.col("_blocks"))
            y = F.when(touches & _meets(x, F.col("_blocks"), same), 1).when(~touches & plain, 0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"), y.alias("y"),
                            touches.alias("taken"), *[f[c].cast("int").alias(c) for c in FEATURES])
        return F.transform(F.filter(f"_w_{kind}", lambda x: _passes(kind, x["m"])), one)

    df = df.withColumn("_cands", F.concat(*[rows(k) for k in KINDS]))
    return df.drop("_t", *[f"_b_{k}" for k in KINDS], *[f"_w_{k}" for k in KINDS])


def _tree_value(tree: dict, value) -> Column:
    """A tree as a Column; ``value(feature)`` gives a feature's Column."""
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(value(tree["feature"]) <= tree["cut"], _tree_value(tree["low"], value)).otherwise(_tree_value(tree["high"], value))


def _margin(model: dict, value) -> Column:
    return reduce(lambda a, b: a + b, [_tree_value(t, value) for t in model["trees"]], F.lit(model["prior"]))


def _best_split(bins_of: dict[int, list]) -> tuple[float, int, int, float, float] | None:
    """(gain, feature, cut, low leaf, high leaf) from the histograms (value, g, h) of all features."""
    best = None
    for j, bins in sorted(bins_of.items()):
        bins.sort()
        gs, hs = sum(b[1] for b in bins), sum(b[2] for b in bins)
        g = h = 0.0
        for v, bg, bh in bins[:-1]:
            g, h = g + bg, h + bh
            gain = g * g / (h + SMOOTH) + (gs - g) ** 2 / (hs - h + SMOOTH) - gs * gs / (hs + SMOOTH)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, j, v, -RATE * g / (h + SMOOTH), -RATE * (gs - g) / (hs - h + SMOOTH))
    return best if best and best[0] > 1e-6 else None


def _grow(graded: DataFrame, cells: Column) -> dict | None:
    """One tree, level by level: a leaf's histograms are one aggregate of Spark."""
    tree: dict = {"leaf": 0.0}
    leaves = {0: tree}
    for _ in range(DEPTH):
        where = _tree_value(_numbered(tree, leaves), F.col).cast("int")
        found: dict[int, dict[int, list]] = {}
        for r in graded.select(where.alias("at"), "g", "h", cells.alias("c")).groupBy("at", "c.j", "c.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            found.setdefault(r["at"], {}).setdefault(r.j, []).append((r.v, r.g, r.h))
        grown = {}
        for no, leaf in leaves.items():
            split = _best_split(found.get(no, {}))
            if split:
                _, j, cut, low, high = split
                leaf.clear()
                leaf.update(feature=FEATURES[j], cut=cut, low={"leaf": low}, high={"leaf": high})
                grown[2 * no + 1], grown[2 * no + 2] = leaf["low"], leaf["high"]
        if not grown:
            break
        leaves = grown
    return tree if "feature" in tree else None


def _numbered(tree: dict, leaves: dict[int, dict]) -> dict:
    """The tree with the number of each leaf in ``leaves`` as its value, -1 in the others."""
    if "leaf" in tree:
        return {"leaf": next((no for no, leaf in leaves.items() if leaf is tree), -1)}
    return {**tree, "low": _numbered(tree["low"], leaves), "high": _numbered(tree["high"], leaves)}


def _variants() -> Column:
    """For a labelled candidate ``x``: itself and, of a positive, its variants, as an array of (y, features)."""
    own = F.struct(F.col("x.y").alias("y"), *[F.col(f"x.{c}").alias(c) for c in FEATURES])
    out = F.array(own)
    for kind, forms in VARIANTS.items():
        made = [F.struct(F.lit(y).alias("y"), *[(F.lit(change[c]) if c in change else F.col(f"x.{c}")).alias(c) for c in FEATURES]) for y, change in forms]
        out = F.when((F.col("x.y") == 1) & (F.col("x.kind") == KINDS.index(kind)), F.concat(F.array(own), F.array(*made))).otherwise(out)
    return out


def _labelled(df: DataFrame, text_col: str) -> DataFrame:
    """A row for each labelled candidate ``x`` and the hash ``t`` of its text."""
    # For a plain explode Spark puts a filter on the array's size below all the projections that make it, each inlined into the next:
    # the search would run again for every use of a column, also inside lambdas.  The filter on y leaves out the rows of empty arrays.
    return _with_candidates(df.select(text_col), text_col).select(F.explode_outer("_cands").alias("x"), F.xxhash64(text_col).alias("t")).filter("x.y is not null")


def train(df: DataFrame, text_col: str = "text") -> dict | None:
    """Boosted trees and thresholds from the labelled candidates of all rows; None without any."""
    cands = _labelled(df, text_col)
    order = F.xxhash64("t", "x.start", "x.kind_no")
    sample = cands.select("x", order.alias("o")).orderBy("o", "x.kind", "x.y").limit(MAX_TRAIN)
    # Equal candidates become one weighted row; a fixed fifth of the hashes calibrates.
    rows = sample.select(F.explode(_variants()).alias("v"), "o").select("v.*", (F.pmod("o", F.lit(5)) == 0).alias("held"))
    table = stored(rows.groupBy("y", *FEATURES, "held").agg(F.count(F.lit(1)).alias("n")), "pii")
    fit = table.filter("not held")
    total = {r.y: r.n for r in fit.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if not total.get(1):
        return None
    model = {"prior": math.log((total[1] + 1) / (total.get(0, 0) + 1)), "trees": [], "cut": {}}
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("v")) for j, c in enumerate(FEATURES)]))
    for _ in range(TREES if total.get(0) else 0):
        p = 1 / (1 + F.exp(-_margin(model, F.col)))
        tree = _grow(fit.select("*", ((p - F.col("y")) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h")), cells)
        if tree is None:
            break
        model["trees"].append(tree)
    margin = F.round(_margin(model, F.col), 3)
    kept = table.filter("held").groupBy("kind", margin.alias("m")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).collect()
    for k in range(len(KINDS)):
        n = y = 0
        cut = None
        mine = sorted((r for r in kept if r.kind == k), key=lambda r: -r.m)
        for r in mine:
            n, y = n + r.n, y + r.y
            if y >= PRECISION * n:
                cut = float(r.m)
        # kinds without a kept candidate are taken from even odds on, kinds that never get precise not at all
        model["cut"][k] = cut if cut is not None else math.inf if mine else 0.0
    return model


def _packed(df: DataFrame, text_col: str, spans_col: str | None = None) -> tuple[DataFrame, list[Column]]:
    """The caller's columns in one struct beside ``_text`` (and ``_found``), so that none of their names meets a working
    column, and the columns that give them back."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    parts = {text_col: "_text"} if spans_col is None else {text_col: "_text", spans_col: "_found"}
    rest = [c for c in df.columns if c not in parts]
    held = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none"))
    back = [F.col(parts[c]).alias(c) if c in parts else F.col(f"_row.c{rest.index(c)}").alias(c) for c in df.columns]
    return df.select(held.alias("_row"), *[named(c).alias(a) for c, a in parts.items()]), back


def find(df: DataFrame, model: dict | None, text_col: str = "text", spans_col: str = "spans", base_col: str = "base_spans") -> DataFrame:
    """Every row with ``base_col`` and ``spans_col``: arrays of (start, kind, end), sorted, kind as its number."""
    df, back = _packed(df.drop(spans_col, base_col), text_col)
    df = _with_candidates(df, "_text")
    pure = lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind"), x["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if model is None:
        added = none
    else:
        def scored(x: Column) -> Column:
            cut = reduce(lambda a, k: F.when(x["kind_no"] == k, model["cut"][k]).otherwise(a), range(len(KINDS)), F.lit(0.0))
            s = F.round(_margin(model, lambda c: x[c]), 3) - cut
            return F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), s.alias("s"))
        df = df.withColumn("_scored", F.array_sort(F.filter(F.transform(F.filter("_cands", lambda x: ~x["taken"]), scored), lambda x: x["s"] >= 0)))
        # Of overlapping candidates the one with the best score stays (then the earliest start).
        better = lambda x: lambda y: F.struct(y["s"], -y["start"], -y["kind_no"]) > F.struct(x["s"], -x["start"], -x["kind_no"])
        added = _once(_in_blocks(F.col("_scored")), lambda blocks: F.transform(F.filter("_scored", lambda x: ~_meets(x, blocks, better(x))), pure))
    return df.select(*back, F.array_sort(F.concat("_base", F.coalesce(added, none))).alias(spans_col), F.col("_base").alias(base_col))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``text_col`` with every span replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    df, back = _packed(df, text_col, spans_col)
    spans, text = F.col("_found"), F.col("_text")
    n = F.size(spans)
    df = df.withColumn("_far", F.when(n > 0, _running(F.transform(spans, lambda x: x["end"]), F.greatest, BLOCK)))
    # A span that starts at or after the end of all before it begins a new one.
    first = lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(F.col("_far"), i - 1))
    df = df.withColumn("_first", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), first)))
    last = lambda j: F.coalesce(F.get(F.col("_first"), j + 1), n) - 1
    joined = F.transform("_first", lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(spans, i)["kind"].alias("kind"), F.get(F.col("_far"), last(j)).alias("end")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    end = F.length(text)
    stops = F.concat(joined, F.array(F.struct(end.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))))
    df = df.withColumn("_one", F.when(n > 0, stops))
    # Before each span: the text since the previous one; then its name.  The last stop is the end of the text.
    froms = F.slice(F.concat(F.array(F.lit(0)), F.transform("_one", lambda x: x["end"])), F.lit(1), F.size("_one"))
    cut = F.when(F.size("_one") > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0)))

    def part(chars: Column, a: Column, z: Column) -> Column:
        """Characters a to z, from the blocks that hold them."""
        low = F.floor(a / CUT).cast("int")
        around = F.array_join(F.slice(chars, low + 1, F.floor((z - 1) / CUT).cast("int") - low + 1), "")
        return F.when(z > a, F.substring(around, a % CUT + 1, z - a)).otherwise("")

    pieces = _once(cut, lambda chars: F.zip_with("_one", froms, lambda x, a: F.concat(part(chars, a, x["start"]), F.element_at(names, x["kind"] + 1))))
    return df.withColumn("_text", F.when(F.size("_one") > 0, F.array_join(pieces, "")).otherwise(text)).select(*back)
