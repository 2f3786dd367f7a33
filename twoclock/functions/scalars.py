"""Small scalar functions, all JVM-side."""

from pyspark.sql import functions as F

# Fixed value: a name or sentence split into runs of letters, camel case apart.
WORD_PATTERN = r"([A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+)"
# Fixed value: words of three letters or fewer say nothing.
SHORTEST_WORD = 4


def num_nonnulls(*cols):
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int") if isinstance(c, str) \
            else total + c.isNotNull().cast("int")
    return total


def uri_slug(prefix, name):
    """`prefix` + name lower-cased, every run of other characters one underscore."""
    slug = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_")
    return F.concat(F.lit(prefix), F.regexp_replace(slug, r"^_|_$", ""))


def stable_id(*cols):
    """An id that is the same on every retry, so a rerun of an ingest adds nothing."""
    return F.md5(F.concat_ws("|", *cols))


def fresh_id():
    return F.uuid()


def json_row(*cols):
    """One row as JSON text: numbers and booleans stay what they are, dates and times
    render in ISO form, NULL is null."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def words(text):
    """Lower-cased words longer than three letters, in order, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 1)
    return F.transform(F.filter(found, lambda w: F.length(w) >= SHORTEST_WORD),
                       lambda w: F.lower(w))
