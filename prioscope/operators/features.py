"""Features: sparse text weights, embeddings, structural columns, and their vector.

Fit results are tables of bounded size (the vocabulary, one row per category, two
numbers per structural column). Scoring is row-local: it broadcasts them and moves
no ticket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prioscope.config import (
    ENCODED_COLUMNS, FEATURE_DISPLAY_NAMES, STRUCTURAL_FEATURES, AuditConfig,
)
from prioscope.functions import text as T
from prioscope.functions.durable import drop, durable
from prioscope.functions.ordering import broadcast_if_bounded, exact_quantiles, number_by
from prioscope.operators.signals import num, usable_minutes

#: Words that a task counts at once; a longer text is counted whole.
WORDS_AT_ONCE = 1_000_000
ENTRY_TYPE = "ARRAY<STRUCT<idx: INT, weight: DOUBLE>>"


# ---------------------------------------------------------------------------
# Text weights
# ---------------------------------------------------------------------------
def _sums(words: list[str], lengths: list[int]) -> pd.DataFrame:
    """(term, tf, df) of some texts, given their words one text after the other, and how many each has."""
    codes, known = pd.factorize(np.array(words, dtype=object))
    text = np.repeat(np.arange(len(lengths)), lengths)

    def counted(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key, how often it occurs and in how many texts: from one sort of (key, text) as one number."""
        n = len(lengths)
        if len(keys) and int(keys.max()) >= np.iinfo(np.int64).max // n:  # texts of very many different words
            found, keys = np.unique(keys, return_inverse=True)
            place, tf, df = counted(keys, texts)
            return found[place], tf, df
        both = np.sort(keys * n + texts)
        new = np.diff(both, prepend=-1) != 0  # the first of its text with this key
        firsts = both[new] // n
        start = np.flatnonzero(np.diff(firsts, prepend=-1))
        at = np.flatnonzero(new)[start]
        return firsts[start], np.diff(at, append=len(both)), np.diff(start, append=len(firsts))

    one, tf, df = counted(codes, text)
    inside = text[1:] == text[:-1]
    two, tf2, df2 = counted((codes[:-1] * len(known) + codes[1:])[inside], text[1:][inside])
    pairs = known[two // len(known)] + " " + known[two % len(known)]
    return pd.DataFrame({
        "term": np.concatenate([known[one], pairs]), "tf": np.concatenate([tf, tf2]), "df": np.concatenate([df, df2])})


def _task_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, tf, df) of texts whose words are parted by spaces: sums of many texts at a time."""
    words: list[str] = []
    lengths: list[int] = []
    for batch in batches:
        for text in batch["words"]:
            before = len(words)
            words += [w for w in text.split(" ") if len(w) > 1]
            lengths.append(len(words) - before)
            if len(words) > WORDS_AT_ONCE:
                yield _sums(words, lengths)
                words, lengths = [], []
    if words:
        yield _sums(words, lengths)


def term_counts(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Occurrences and document frequency of every term, with one shuffle by term.

    Words are counted many texts at a time, as numbers, and added up in the task before they are sent: no
    row a word is made, and a term that is everywhere is sent once a task.
    """
    counted = df.selectExpr(f"{T.spaced_words(text)} AS words").mapInPandas(_task_counts, "term STRING, tf LONG, df LONG")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def top_terms(counts: DataFrame, n_docs: int, config: AuditConfig = AuditConfig()) -> DataFrame:
    """The vocabulary: frequent enough terms, most occurrences first, ties by term."""
    kept = (
        counts.filter(F.col("df") >= config.tfidf_min_df)
        .orderBy(F.desc("tf"), "term").limit(config.tfidf_max_features)
    )
    # the window sees at most tfidf_max_features rows
    position = F.row_number().over(Window.orderBy("term")) - 1
    return kept.withColumn("idx", position.cast("int")).withColumn(
        "idf", F.expr(f"ln((1D + {n_docs}) / (1D + df)) + 1D")
    )


@dataclass(frozen=True)
class TfidfModel:
    vocabulary: DataFrame  # term, tf, df, idx, idf
    n_docs: int
    size: int

    @classmethod
    def fit(cls, df: DataFrame, config: AuditConfig = AuditConfig(),
            text: str = "full_text") -> TfidfModel:
        n_docs = df.count()
        vocabulary = durable(top_terms(term_counts(df, text), n_docs, config))
        return cls(vocabulary, n_docs, vocabulary.count())

    def terms(self) -> list:
        """The vocabulary in index order: at most ``tfidf_max_features`` rows."""
        return self.vocabulary.select("term", "idf").orderBy("idx").collect()

    def with_entries(self, df: DataFrame, name: str = "entries", text: str = "full_text") -> DataFrame:
        """Add the L2-normalised weights of the row's terms, by index: (1 + ln tf) x idf.

        Row by row, without a shuffle: terms are looked up by hash in the vocabulary. An
        id that repeats is two rows. Rows without any known term have no entries.
        """
        terms = self.terms()
        if not terms:
            return df.withColumn(name, F.expr(f"CAST(array() AS {ENTRY_TYPE})"))
        counted = CountVectorizerModel.from_vocabulary(
            [t.term for t in terms], inputCol="_terms", outputCol="_counts", minTF=1.0
        ).transform(T.derive(df, {"_terms": T.terms(text)})).withColumn("_u", F.unwrap_udt("_counts"))
        weights = T.let("idf", T.doubles([t.idf for t in terms]), (
            "zip_with(_u.indices, _u.values, (i, tf) -> "
            "named_struct('idx', i, 'weight', (1D + ln(tf)) * get(idf, i)))"
        ))
        norm = "sqrt(aggregate(e, 0D, (acc, x) -> acc + x.weight * x.weight))"
        scaled = T.let("e", weights, T.let("norm", norm, (
            "transform(e, x -> named_struct('idx', x.idx, 'weight', x.weight / norm))"
        )))
        return T.derive(counted, {name: f"CAST({scaled} AS {ENTRY_TYPE})"}).drop("_terms", "_counts", "_u")

    def weights(self, df: DataFrame, key: str = "ticket_id",
                text: str = "full_text") -> DataFrame:
        """The same as one row per (key, idx)."""
        return entry_rows(self.with_entries(df.select(key, text), "entries", text), key)


# ---------------------------------------------------------------------------
# Embeddings
# ---------------------------------------------------------------------------
def l2_normalised(vector: str) -> str:
    norm = f"sqrt(aggregate({vector}, 0D, (acc, x) -> acc + CAST(x AS DOUBLE) * x))"
    return T.let("n", norm, f"transform({vector}, x -> IF(n > 0, x / n, CAST(x AS DOUBLE)))")


def embed_texts(df: DataFrame, make_predict: Callable, batch_size: int = 64,
                text: str = "full_text") -> DataFrame:
    """Run a caller's sentence encoder in Arrow batches and normalise its vectors."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    model = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()),
                              batch_size=batch_size)
    return T.derive(df.withColumn("embedding", model(F.coalesce(text, F.lit("")))),
                    {"embedding": l2_normalised("embedding")})


# ---------------------------------------------------------------------------
# Category codes
# ---------------------------------------------------------------------------
def category_value(column: str) -> str:
    return f"lower({T.strip(f'coalesce(CAST({column} AS STRING), {T.sql_string("unknown")})')})"


def fit_encoders(df: DataFrame, columns: tuple[str, ...] = ENCODED_COLUMNS) -> DataFrame:
    """(column, value, code): codes follow the order of the distinct values.

    ``distinct`` combines before its shuffle, so a value of most rows stays one row.
    """
    pairs = ", ".join(
        f"named_struct('column', '{c}', 'value', {category_value(c)})" for c in columns
    )
    values = df.selectExpr(f"inline(array({pairs}))").distinct()
    placed = number_by(values, ["column", "value"], "_at")
    first = placed.groupBy("column").agg(F.min("_at").alias("_first"))  # one row per column
    return placed.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_at") - F.col("_first")).cast("int").alias("code")
    )


def encode(df: DataFrame, encoders: DataFrame, columns: tuple[str, ...] = ENCODED_COLUMNS) -> DataFrame:
    """Add ``<column>_enc``; unseen values take the code of 'unknown', else 0.

    One small job reads the size and the fallback of every column's table.
    """
    facts = {r["column"]: r for r in encoders.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("value") == "unknown", F.col("code"))).alias("unknown")
    ).collect()}
    for c in columns:
        codes = encoders.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        known = facts.get(c)
        df = (
            T.derive(df, {"_value": category_value(c)})
            .join(broadcast_if_bounded(codes, known["n"] if known else 0), "_value", "left")
            .withColumn(f"{c}_enc", F.coalesce("_code", F.lit((known["unknown"] if known else 0) or 0)))
            .drop("_value", "_code")
        )
    return df


# ---------------------------------------------------------------------------
# Structural columns
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class FeatureStats:
    """Frozen whole-table numbers behind the satisfaction and duration features."""

    csat_min: float | None
    csat_max: float | None
    csat_median: float | None
    response_median: float | None
    resolution_median: float | None

    @classmethod
    def fit(cls, df: DataFrame) -> FeatureStats:
        narrow = df.selectExpr(
            "csat_numeric AS csat",
            f"{usable_minutes('first_response_minutes')} AS response",
            f"{usable_minutes('resolution_time_minutes')} AS resolution",
        )
        facts = narrow.agg(*[
            f(c).alias(f"{name}_{c}") for c in narrow.columns
            for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
        ]).first().asDict()
        medians = exact_quantiles(narrow, {c: [0.5] for c in narrow.columns}, facts)
        return cls(facts["lo_csat"], facts["hi_csat"], medians["csat"][0], medians["response"][0],
                   medians["resolution"][0])


def structural_sql(stats: FeatureStats) -> dict[str, str]:
    """The 15 unscaled structural features, over encoded and labelled tickets."""
    csat, inverted = "0.5D", "0.5D"
    if stats.csat_median is not None:
        width = stats.csat_max - stats.csat_min + 1e-9
        csat = (
            f"(coalesce(csat_numeric, {num(stats.csat_median)}) - {num(stats.csat_min)}) "
            f"/ {num(width)}"
        )
        inverted = f"1D - {csat}"

    def logged(column: str, median: float | None) -> str:
        return f"log1p(coalesce({usable_minutes(column)}, {num(median or 0.0)}))"

    of_text = T.text_stats("coalesce(full_text, '')")
    sql = {c: of_text[c] for c in STRUCTURAL_FEATURES[:5]} | {
        "csat_norm": csat,
        "csat_inverted": inverted,
        "first_response_minutes_norm": logged("first_response_minutes", stats.response_median),
        "resolution_time_minutes_norm": logged("resolution_time_minutes", stats.resolution_median),
    }
    sql |= {f"{c}_enc": f"{c}_enc" for c in ENCODED_COLUMNS}
    sql |= {c: f"coalesce({c}, 0D)" for c in STRUCTURAL_FEATURES[-3:]}
    return {c: f"CAST({sql[c]} AS DOUBLE)" for c in STRUCTURAL_FEATURES}


def structural_features(df: DataFrame, stats: FeatureStats, encoders: DataFrame,
                        keep: tuple[str, ...] = ("ticket_id",)) -> DataFrame:
    """``keep`` and the 15 unscaled structural features, all doubles."""
    return encode(df, encoders).selectExpr(
        *keep, *[f"{sql} AS {c}" for c, sql in structural_sql(stats).items()]
    )


@dataclass(frozen=True)
class RobustScaling:
    """Median and interquartile range per column; a zero range divides by one."""

    centers: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: tuple[str, ...] = STRUCTURAL_FEATURES) -> RobustScaling:
        quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
        spread = {c: (q[2] or 0.0) - (q[0] or 0.0) for c, q in quartiles.items()}
        return cls(
            {c: q[1] or 0.0 for c, q in quartiles.items()},
            {c: s if s > 0 else 1.0 for c, s in spread.items()},
        )

    def scaled(self, column: str, value: str) -> str:
        return f"({value} - {num(self.centers[column])}) / {num(self.scales[column])}"

    def transform(self, df: DataFrame) -> DataFrame:
        return T.derive(df, {c: self.scaled(c, c) for c in self.centers})


# ---------------------------------------------------------------------------
# Names and vectors
# ---------------------------------------------------------------------------
def feature_names(vocabulary: DataFrame, embedding_dim: int) -> DataFrame:
    """(idx, name) in vector order: terms, embedding dimensions, structural columns."""
    spark = vocabulary.sparkSession
    n_terms = vocabulary.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    terms = vocabulary.selectExpr("idx", "concat('tfidf:', term) AS name")
    dims = spark.range(embedding_dim).selectExpr(
        f"CAST({n_terms} + id AS INT) AS idx", "concat('sbert_', id) AS name")
    offset = n_terms + embedding_dim
    columns = spark.range(1).selectExpr(
        f"posexplode({T.sql_strings(STRUCTURAL_FEATURES)}) AS (i, name)"
    ).selectExpr(f"CAST({offset} + i AS INT) AS idx", "name")
    return terms.unionByName(dims).unionByName(columns)


def humanised_name(name: str) -> str:
    """Readable form of a feature name."""
    return (
        f"CASE WHEN startswith({name}, 'tfidf:') "
        f"THEN concat('Text keyword: \"', substring({name}, 7), '\"') "
        f"WHEN startswith({name}, 'sbert_') THEN 'Semantic content embedding' "
        f"ELSE coalesce({T.sql_case(name, FEATURE_DISPLAY_NAMES)}, "
        f"initcap(replace({name}, '_', ' '))) END"
    )


VECTOR = StructType([StructField("v", VectorUDT())])


def as_vector(indices: str, values: str, size: int):
    """A sparse ML vector column from SQL expressions for its indices and values.

    SQL has no cast to a vector, but the JSON reader builds one from its four fields;
    numbers keep all their digits on the way.
    """
    fields = F.expr(
        f"named_struct('v', named_struct('type', 0Y, 'size', {size}, "
        f"'indices', {indices}, 'values', {values}))"
    )
    return F.from_json(F.to_json(fields), VECTOR)["v"]


def with_vector_entries(df: DataFrame, vector: str = "features", name: str = "entries") -> DataFrame:
    """Add the non-zero features of a sparse vector column, by index."""
    zipped = "zip_with(_v.indices, _v.values, (i, x) -> named_struct('idx', i, 'weight', x))"
    return T.derive(df.withColumn("_v", F.unwrap_udt(vector)), {
        name: f"CAST({zipped} AS {ENTRY_TYPE})"}).drop("_v")


def entry_rows(df: DataFrame, key: str, name: str = "entries") -> DataFrame:
    """One row per (key, idx). Outer, then without the rows of no entries: before an inner ``inline`` the
    optimizer puts a filter on the array's size, which has all that makes the array in it, once a mention."""
    return df.selectExpr(key, f"inline_outer({name})").filter("idx IS NOT NULL")


@dataclass(frozen=True)
class FeatureModel:
    """Everything fitted on the training rows that scoring needs again."""

    tfidf: TfidfModel
    stats: FeatureStats
    encoders: DataFrame
    scaling: RobustScaling
    embedding_dim: int = 0

    @property
    def size(self) -> int:
        return self.tfidf.size + self.embedding_dim + len(STRUCTURAL_FEATURES)

    @classmethod
    def fit(cls, df: DataFrame, config: AuditConfig = AuditConfig()) -> FeatureModel:
        """``df`` is read several times: give a durable table when it is costly."""
        if "full_text" not in df.columns:
            raise ValueError("Features need the full_text column.")
        stats = FeatureStats.fit(df)
        encoders = durable(fit_encoders(df))
        raw = durable(structural_features(df, stats, encoders, ()))
        scaling = RobustScaling.fit(raw)
        drop(raw)
        dim = 0
        if "embedding" in df.columns:
            dim = df.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        return cls(
            TfidfModel.fit(df, config), stats, encoders, scaling, max(dim, 0),
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``. No shuffle: fitted tables are broadcast, rows stay in place."""
        dense = ", ".join(
            self.scaling.scaled(c, sql) for c, sql in structural_sql(self.stats).items()
        )
        if self.embedding_dim:
            blank = f"array_repeat(0D, {self.embedding_dim})"
            dense = f"concat(coalesce(CAST(embedding AS ARRAY<DOUBLE>), {blank}), array({dense}))"
        else:
            dense = f"array({dense})"
        codes = [f"{c}_enc" for c in ENCODED_COLUMNS]
        rows = self.tfidf.with_entries(T.derive(encode(df, self.encoders), {"_dense": dense}), "_entries")
        rows = T.derive(rows, {"_present": "filter(sequence(0, size(_dense) - 1), j -> get(_dense, j) <> 0)"})
        indices = f"concat(_entries.idx, transform(_present, j -> j + {self.tfidf.size}))"
        present = T.let("d", "_dense", "transform(_present, j -> get(d, j))")
        return rows.withColumn(
            "features", as_vector(indices, f"concat(_entries.weight, {present})", self.size)
        ).drop("_entries", "_dense", "_present", *codes)

    def names(self) -> list[str]:
        """Feature names in vector order: as many as the model has features."""
        rows = feature_names(self.tfidf.vocabulary, self.embedding_dim)
        return [r.name for r in rows.orderBy("idx").collect()]

    def save(self, path: str) -> None:
        """Tables for the vocabulary, the encoders and the handful of numbers."""
        spark = self.encoders.sparkSession
        # copied first: the model may have been loaded from this folder
        durable(self.tfidf.vocabulary).write.mode("overwrite").parquet(f"{path}/vocabulary")
        durable(self.encoders).write.mode("overwrite").parquet(f"{path}/encoders")
        spark.createDataFrame(
            [(c, self.scaling.centers[c], self.scaling.scales[c]) for c in self.scaling.centers],
            "name STRING, center DOUBLE, scale DOUBLE",
        ).write.mode("overwrite").parquet(f"{path}/scaling")
        facts = asdict(self.stats) | {
            "n_docs": float(self.tfidf.n_docs), "n_terms": float(self.tfidf.size),
            "embedding_dim": float(self.embedding_dim),
        }
        spark.createDataFrame(
            list(facts.items()), "name STRING, value DOUBLE"
        ).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        facts = {r.name: r.value for r in spark.read.parquet(f"{path}/facts").collect()}
        scaling = spark.read.parquet(f"{path}/scaling").collect()
        stats = FeatureStats(**{k: facts[k] for k in FeatureStats.__dataclass_fields__})
        return cls(
            TfidfModel(spark.read.parquet(f"{path}/vocabulary"), int(facts["n_docs"]),
                       int(facts["n_terms"])),
            stats,
            spark.read.parquet(f"{path}/encoders"),
            RobustScaling({r.name: r.center for r in scaling}, {r.name: r.scale for r in scaling}),
            int(facts["embedding_dim"]),
        )
