"""License scan by ordered signature rules, in DataFrame operations only.

Texts become their words, lower-cased and joined by single spaces, so that a
rule is one regular expression over words.  A text that holds no gate word
is done after that.  For the others the keywords present choose the rules
(a join with the small rule table on the keyword), and only these rules'
expressions run.  Every match is an interval of words.  Intervals are
resolved by priority and containment: a match inside another one of the same
text is dropped if the other's kind ranks at least as high.  This is one
running maximum over the text's intervals, sorted by start and length, so a
text with very many matches is no quadratic case.

Defined results: NULL and empty texts have no words, no labels and score 0;
rows that repeat an id and a text are scanned as one and each get the
result; rows with a NULL id are scanned like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

from .license_rules import BASE, CONFIDENCE, GATES, KINDS, rules
from .registry import load, query

# Everything of ASCII but digits and letters separates words.
NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(x: Column) -> Column:
    """One space stands before every word."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _phrase(p: str) -> str:
    return f" (?:{p})(?= )"


def _words_of(text: Column) -> Column:
    """`` w0 w1 ... `` with one space around every word; one space if none."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORDS, " "))
    return F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def detections(texts: DataFrame) -> DataFrame:
    """``id``, ``h``, ``label``, ``kind``, ``rank``, ``rule``, ``start`` and
    ``end`` (words, end exclusive) of every rule match in the gated rows
    (``id``, ``h``, ``words``)."""
    spark = texts.sparkSession
    table = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(kind).alias("kind"),
                 F.lit(KINDS.index(kind)).alias("rank"), F.lit(keyword).alias("keyword"),
                 F.lit(_phrase(pattern)).alias("pattern"))
        for n, (label, kind, keyword, pattern) in enumerate(rules())])))
    keywords = F.array(*[F.lit(k) for k in sorted({r[2] for r in rules()})])
    present = texts.withColumn("keyword", F.explode(F.filter(
        keywords, lambda k: F.contains(F.col("words"), k))))
    hits = (present.join(F.broadcast(table), "keyword")  # a few hundred rows
            .filter(F.expr("words rlike pattern")))
    between = F.expr("transform(split(words, pattern, -1), "
                     "x -> length(x) - length(replace(x, ' ', '')))")
    inside = F.expr("transform(regexp_extract_all(words, pattern, 0), "
                    "x -> length(x) - length(replace(x, ' ', '')))")
    places = (hits.select("id", "h", "rule", "label", "kind", "rank",
                          F.posexplode(F.arrays_zip(between.alias("gap"), inside.alias("n")))
                          .alias("at", "m"))
              .select("id", "h", "rule", "label", "kind", "rank", "at", "m.gap", "m.n")
              .filter("n IS NOT NULL").distinct())
    upto = (Window.partitionBy("id", "h", "rule").orderBy("at")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return (places.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
            .drop("at", "gap", "n"))


def resolve(found: DataFrame) -> DataFrame:
    """The matches that lie in no other match of an equal or better kind."""
    before = (Window.partitionBy("id", "h").orderBy("start", F.desc("end"), "rank", "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    reach = [F.max(F.when(F.col("rank") <= r, F.col("end"))).over(before).alias(f"reach{r}")
             for r in range(len(KINDS))]
    covered = F.element_at(F.array(*[F.col(f"reach{r}") for r in range(len(KINDS))]),
                           F.col("rank") + 1)
    return (found.select("*", *reach).filter(covered.isNull() | (covered < F.col("end")))
            .drop(*[f"reach{r}" for r in range(len(KINDS))]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` (confidence of the best match
    left) and ``n_matches`` of every row."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"),
                     _words_of(text).alias("raw")).withColumn("low", F.lower("raw"))
    # ASCII letters only, and only where a gate word makes it worthwhile
    gated = _any_of(F.col("low"), GATES)
    rows = rows.select("id", "h", (_spaces(F.col("raw")) - 1).cast("long").alias("n_words"),
                       F.when(gated, F.translate("raw", UPPER, LOWER)).alias("words"))
    # written once: the words of gated texts only, and numbers for the others
    rows = cut_lineage(rows)

    # base phrases do not overlap themselves: pieces between them tell all
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        parts = F.split("words", _phrase(phrase))
        n = F.size(parts) - 1
        some = F.col("words").isNotNull() & (n > 0)
        counts.append(F.when(some, n).otherwise(0))
        firsts.append(F.when(some, _spaces(parts[0])))
        # spaces behind the last place: one before each word and one at the end
        lasts.append(F.when(some, F.col("n_words") + 1 - _spaces(F.element_at(parts, -1))
                            - len(phrase.split())))
        labels.append(F.when(some, F.lit(label)))
    base = rows.select("id", "h", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"),
                       F.least(*firsts).cast("long").alias("first_word"),
                       F.greatest(*lasts).cast("long").alias("last_word"),
                       F.array_compact(F.array(*labels)).alias("base"))

    left = resolve(detections(rows.filter("words IS NOT NULL").select("id", "h", "words")))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]),
                          F.col("kind"))
    more = left.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(
        F.collect_set("label").alias("found"), F.max(weight).alias("score"),
        F.count(F.lit(1)).alias("n_matches"))
    none = F.array().cast("array<string>")
    out = base.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                      F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                      F.array_join(every, ",").alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


@query("op2_license_rules")
def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan(load(spark, sf_dir, "documents"))
