"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Everything that touches rows is a DataFrame or SQL function. Trees are grown level by
level from histograms: one grouping sums gradients by (node, feature, bin), and the
driver picks splits from that table, whose size depends on bins and nodes alone.
"""

import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes share this many statistics by hash, so the table of them has a fixed bound.
CELLS = 4096
FOLDS = 5
#: Gradients are summed as whole numbers, so sums do not depend on the order of rows.
UNIT = float(1 << 20)

LEXICAL = ["length", "host_length", "host_depth", "path_length", "path_depth",
           "digit_ratio", "entropy", "parameters", "query_length", "hyphens"]
SUFFIXES = ["top", "domain", "section"]
FEATURES = LEXICAL + [f"{s}_rate" for s in SUFFIXES]


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and how the path begins; `verdict` allow or block."""
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self):
        return self.host + self.path


@dataclass
class Filter:
    """What training gives: suffix statistics (a small frame per kind, or None), the
    share of blocked URLs, and trees as nested (feature, threshold, low, high) or leaves."""
    suffixes: dict
    base_rate: float
    margin: float
    trees: list


def _own(name):
    return F.col(OWN + name)


def parsed(pages, url="url"):
    """Adds host, path and the text after them under our own names. The host runs from
    the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; the path from there to
    `?`, `#` or the end. Without `://`, or for NULL, all are empty."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(_own("rest"), r"(?s)^[^/?#]*", 0)
    tail = F.substring(_own("rest"), F.length(host) + 1, F.length("`" + OWN + "rest`"))
    path = F.regexp_extract(_own("tail"), r"(?s)^[^?#]*", 0)
    after = F.substring(_own("tail"), F.length(path) + 1, F.length("`" + OWN + "tail`"))
    return (pages.withColumn(OWN + "url", text).withColumn(OWN + "rest", rest)
            .withColumn(OWN + "tail", tail)
            .withColumn(OWN + "host", F.translate(host, UPPER, LOWER))
            .withColumn(OWN + "path", path).withColumn(OWN + "after", after)
            .drop(OWN + "rest", OWN + "tail"))


def with_rule(pages, rules):
    """Adds the name and verdict of the longest rule that fits (equal lengths: the longer
    host), NULL where none does. `rules` is a list its caller wrote down, so it rides
    along as literals: the first match in longest-first order, no join, no hot host."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = _own("host"), _own("path")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pages.withColumn(OWN + "rule", found).withColumn(OWN + "ruled", verdict)


def _without(column, characters):
    return F.length(F.translate(column, characters, ""))


def lexical(pages):
    """Adds the lexical features and the cell of each suffix to a parsed frame."""
    url, host, path, after = (_own(n) for n in ("url", "host", "path", "after"))
    size = F.length(url)
    plain = F.regexp_replace(url, r"[^\x00-\x7F]", "¿")

    def surprise(total, character):
        share = (size - F.length(F.replace(plain, character, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    entropy = F.aggregate(F.array_distinct(F.split(plain, "")), F.lit(0.0), surprise)
    query = F.regexp_extract(after, r"(?s)^\?([^#]*)", 1)
    numbers = {
        "length": size, "host_length": F.length(host), "path_length": F.length(path),
        "host_depth": F.length(host) - _without(host, "."),
        "path_depth": F.length(path) - _without(path, "/"),
        "digit_ratio": (size - _without(url, "0123456789")) / F.greatest(size, F.lit(1)),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(
            F.length(query) - _without(query, "&") + 1),
        "query_length": F.length(query), "hyphens": size - _without(url, "-"),
    }
    top = F.substring_index(host, ".", -1)
    domain = F.substring_index(host, ".", -2)
    section = F.concat_ws("/", top, F.get(F.split(path, "/", 3), F.lit(1)))
    pages = pages.withColumns({OWN + k: numbers[k].cast("double") for k in LEXICAL})
    return pages.withColumns({
        OWN + k: F.pmod(F.xxhash64(F.lit(k), v), F.lit(CELLS)).cast("int")
        for k, v in zip(SUFFIXES, (top, domain, section), strict=True)})


def _suffix_statistics(labelled):
    """Per kind a frame (cell, blocked, seen) with one entry per fold in the arrays. All
    labelled rows are counted; a hot suffix is summed before the shuffle, and each frame
    has at most CELLS rows, which bounds its broadcast."""
    out = {}
    for kind in SUFFIXES:
        fold = F.col(OWN + "fold")
        out[kind] = kept(labelled.groupBy(F.col(OWN + kind).alias(OWN + "cell")).agg(
            F.array(*[F.sum(F.when(fold == k, _own("label")).otherwise(0)) for k in range(FOLDS)])
            .alias(OWN + "blocked"),
            F.array(*[F.sum(F.when(fold == k, 1).otherwise(0)) for k in range(FOLDS)])
            .alias(OWN + "seen")))
    return out


def _with_rates(pages, suffixes, base_rate, own_fold, weight=8.0):
    """Adds how often URLs of the same suffix were blocked, drawn towards the overall
    share by `weight` rows. A training row leaves its own fold out, so that it never
    sees its own label."""
    for kind in SUFFIXES:
        if kind not in suffixes:
            pages = pages.withColumn(f"{OWN}{kind}_rate", F.lit(base_rate))
            continue
        pages = pages.join(
            F.broadcast(suffixes[kind].withColumnRenamed(OWN + "cell", OWN + kind)),
            OWN + kind, "left")

        def outside(name):
            total = F.aggregate(name, F.lit(0).cast("long"), lambda a, b: a + b)
            return F.coalesce(total - F.get(F.col(name), F.col(OWN + "fold")) if own_fold
                              else total, F.lit(0))
        rate = (outside(OWN + "blocked") + weight * base_rate) / (outside(OWN + "seen") + weight)
        pages = pages.withColumn(f"{OWN}{kind}_rate", rate).drop(OWN + "blocked", OWN + "seen")
    return pages


def tree_value(tree, column):
    """A tree as an expression over `column(feature)`."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, low, high = tree
    return (F.when(column(feature) <= F.lit(float(threshold)), tree_value(low, column))
            .otherwise(tree_value(high, column)))


def _margin(margin, trees, column):
    total = F.lit(float(margin))
    for tree in trees:
        total = total + tree_value(tree, column)
    return total


def best_split(cells, bins, smallest=1.0, ridge=1.0):
    """(gain, feature, bin, low, high) of the best split of one node, or None. `cells`
    maps (feature, bin) to (gradient sum, curvature sum), as `low` and `high` are; rows of
    at most `bin` go low. Ties go to the first feature, then the lowest bin."""
    best = None
    for feature in sorted({f for f, _ in cells}):
        row = [cells.get((feature, b), (0.0, 0.0)) for b in range(bins)]
        g, h = sum(x for x, _ in row), sum(x for _, x in row)
        low_g = low_h = 0.0
        for b in range(bins - 1):
            low_g, low_h = low_g + row[b][0], low_h + row[b][1]
            if low_h < smallest or h - low_h < smallest:
                continue
            gain = (low_g ** 2 / (low_h + ridge) + (g - low_g) ** 2 / (h - low_h + ridge)
                    - g ** 2 / (h + ridge))
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, feature, b, (low_g, low_h), (g - low_g, h - low_h))
    return best


def _node_of(tree):
    """Number of the open leaf a row falls in; closed leaves give NULL. Open leaves are
    given as `("open", n)`."""
    if isinstance(tree, tuple) and tree[0] == "open":
        return F.lit(tree[1])
    if not isinstance(tree, tuple):
        return F.lit(None).cast("int")
    feature, at, low, high = tree
    return F.when(F.col(f"b{feature}") <= at, _node_of(low)).otherwise(_node_of(high))


def _replaced(tree, parts):
    if isinstance(tree, tuple) and tree[0] == "open":
        return parts[tree[1]]
    if not isinstance(tree, tuple):
        return tree
    feature, at, low, high = tree
    return (feature, at, _replaced(low, parts), _replaced(high, parts))


def _grown(binned, bins, margin, trees, depth, rate, ridge=1.0):
    """One more tree, on bins, for the logistic loss at the margins so far."""
    score = _margin(margin, trees, lambda f: F.col(f"b{f}"))
    chance = 1 / (1 + F.exp(-score))
    rows = (binned.withColumn("g", F.round((F.col("n") * chance - F.col("blocked")) * UNIT)
                              .cast("long"))
            .withColumn("h", F.round(F.col("n") * chance * (1 - chance) * UNIT).cast("long")))
    def leaf(g, h):
        return -rate * g / (h + ridge)

    tree = ("open", 0)
    for level in range(depth):
        placed = rows.withColumn("node", _node_of(tree)).where("node is not null")
        sums = placed.select("node", "g", "h", F.explode(F.array(*[
            F.lit(f * bins) + F.col(f"b{f}") for f in range(len(FEATURES))])).alias("cell"))
        table = sums.groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        nodes = {}
        for r in table.collect():
            nodes.setdefault(r["node"], {})[divmod(r["cell"], bins)] = (
                r["g"] / UNIT, r["h"] / UNIT)
        parts, opened = {}, 0
        for node, cells in sorted(nodes.items()):
            split = best_split(cells, bins, ridge=ridge)
            if not split:
                first = [v for (f, _), v in cells.items() if f == 0]
                parts[node] = leaf(sum(g for g, _ in first), sum(h for _, h in first))
            elif level == depth - 1:
                parts[node] = (split[1], split[2], leaf(*split[3]), leaf(*split[4]))
            else:
                parts[node] = (split[1], split[2], ("open", opened), ("open", opened + 1))
                opened += 2
        tree = _replaced(tree, parts)
        if not opened:
            break
    return tree


def _on_values(tree, cuts):
    """A tree on bins as one on values: bin b holds what is at most cuts[b]. Past the
    last cut there is no bin to split at."""
    if not isinstance(tree, tuple):
        return tree
    feature, at, low, high = tree
    if at >= len(cuts[feature]):
        return _on_values(low, cuts)
    return (feature, cuts[feature][at], _on_values(low, cuts), _on_values(high, cuts))


def train(labelled, url="url", label="label", trees=12, depth=3, bins=16, rate=0.4,
          sample=50_000):
    """A `Filter` from labelled URLs (`label` 1: block, 0: allow; other rows are left
    out). Suffix statistics count all of them. Trees are fitted on about `sample` of the
    distinct URLs, drawn by hash, each with all its copies as one weighted row. Labels of
    one kind, or none, give no trees: every URL then scores the overall share (0 when
    nothing is labelled)."""
    rows = lexical(parsed(labelled.select(
        F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("int").alias(OWN + "label"))
        .where(_own("label").isin(0, 1))))
    rows = rows.withColumn(OWN + "hash", F.xxhash64(OWN + "url"))
    rows = rows.withColumn(OWN + "fold", F.pmod(_own("hash"), F.lit(FOLDS)).cast("int"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(OWN + "label").alias("blocked"),
                    F.approx_count_distinct(OWN + "hash").alias("urls")).head()
    n, blocked = seen["n"], seen["blocked"] or 0
    base = blocked / n if n else 0.0
    if blocked in (0, n):
        return Filter({}, base, 30.0 if n and blocked else -30.0, [])
    suffixes = _suffix_statistics(rows)
    share = min(1.0, sample / seen["urls"])
    if share < 1:
        # Another hash than the one behind the folds.
        rows = rows.where(F.pmod(F.xxhash64(F.lit(1), OWN + "hash"), F.lit(1 << 20))
                          < int(share * (1 << 20)))
    drawn = kept(_with_rates(rows, suffixes, base, own_fold=True).groupBy(
        *[F.col(OWN + k).alias(k) for k in FEATURES]).agg(
            F.count(F.lit(1)).alias("n"), F.sum(OWN + "label").alias("blocked")))
    held = drawn.agg(*[F.percentile_approx(k, [i / bins for i in range(1, bins)], 10_000)
                       .alias(k) for k in FEATURES]).head()
    cuts = [sorted(set(held[k] or [])) for k in FEATURES]
    binned = kept(drawn.select("n", "blocked", *[
        sum((F.when(F.col(k) > F.lit(float(c)), 1).otherwise(0) for c in cuts[f]),
            F.lit(0)).alias(f"b{f}") for f, k in enumerate(FEATURES)])
        .groupBy(*[f"b{f}" for f in range(len(FEATURES))])
        .agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")))
    total = binned.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).head()
    share = min(max((total["blocked"] or 0) / (total["n"] or 1), 1e-6), 1 - 1e-6)
    margin, grown = math.log(share / (1 - share)), []
    for _ in range(trees):
        tree = _grown(binned, bins, margin, grown, depth, rate)
        if not isinstance(tree, tuple):
            # Nothing left that a split would tell apart.
            break
        grown.append(tree)
    return Filter(suffixes, base, margin, [_on_values(t, cuts) for t in grown])


def _scored(rows, model):
    """Adds the chance that a URL is to be blocked."""
    rows = _with_rates(rows, model.suffixes, model.base_rate, own_fold=False)
    margin = _margin(model.margin, model.trees, lambda f: _own(FEATURES[f]))
    return rows.withColumn(OWN + "score", 1 / (1 + F.exp(-margin)))


def judge(pages, rules, model=None, url="url", carry=("page_id",), block_at=0.5):
    """For each row of `pages`: the columns named in `carry`, `host`, `path`, `rule` (the
    name of the longest rule that fits, or NULL), `verdict` (allow or block: the rule's,
    else the trees': block from a score of `block_at`) and `score` (the trees').

    Without a `model`, one is trained from the URLs that a rule judges. NULL, empty and
    malformed URLs have an empty host and path, fit no rule and are judged by the trees
    like any other; URLs of any length count whole. Repeated rows are judged alike, an
    empty table gives an empty one, and further columns, whatever their names, are left
    out; so is a column of `carry` with the name of a result.
    """
    out = ("host", "path", "rule", "verdict", "score")
    carry = [c for c in carry if c not in out]
    rows = with_rule(parsed(pages.select(F.col(f"`{url}`").alias("url"), *[
        F.col(f"`{c}`").alias(OWN + "carry_" + c) for c in carry])), rules)
    if model is None:
        model = train(rows.where(_own("ruled").isNotNull()).select(
            "url", (_own("ruled") == "block").cast("int").alias("label")))
    found = _scored(lexical(rows), model)
    by_trees = F.when(_own("score") >= block_at, "block").otherwise("allow")
    return found.select(*[_own("carry_" + c).alias(c) for c in carry],
                        _own("host").alias("host"), _own("path").alias("path"),
                        _own("rule").alias("rule"),
                        F.coalesce(_own("ruled"), by_trees).alias("verdict"),
                        _own("score").alias("score"))
