"""URL filters: host and path rules, then a character language-model ratio (native)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, quantile, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed: the rules that the job gives.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


@dataclass(frozen=True)
class Settings:
    """rows_per_task: URLs whose characters a task counts, as a URL gives some hundred counts."""

    order: int = 4  # characters of context at most
    buckets: int = 1 << 17
    strength: float = 4.0  # weight of the shorter context's estimate
    alphabet: int = 256
    rows_per_task: int = 20_000
    accepted_loss: float = 0.05
    folds: int = 5
    seed: int = 23


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both empty for a null or one without `://`; only A-Z are lower-cased."""
    u = F.coalesce(F.col(url), F.lit(""))
    found = F.instr(u, "://")
    rest = F.when(found > 0, F.substring(u, found + 3, F.char_length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: str, s: Settings) -> Column:
    """By position, for contexts of 0 to order characters: the bucket of the context, then that of context and character."""
    t = F.concat(F.lit("\u0001" * s.order), F.col(text))
    at = F.sequence(F.lit(s.order + 1), F.char_length(t))

    def one(i: Column) -> Column:
        return F.array(*(
            F.pmod(F.xxhash64(F.lit(2 * n + more), F.substring(t, i - n, F.lit(n + more))), F.lit(s.buckets)).cast("int")
            for n in range(s.order + 1)
            for more in (0, 1)
        ))

    return F.when(F.char_length(F.col(text)) > 0, F.transform(at, one)).otherwise(F.array().cast("array<array<int>>"))


def counts(examples: DataFrame, s: Settings) -> DataFrame:
    """One row of an array by bucket: how often the accepted (a) and the rejected (r) examples have it."""
    flat = examples.select("good", F.explode(F.flatten(grams("url", s))).alias("b"))
    by = flat.groupBy("b").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    ids = examples.sparkSession.range(s.buckets).select(F.col("id").cast("int").alias("b"))
    full = ids.join(by, "b", "left").select(F.struct("b", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["a"], x["r"])).alias("m"))


def with_ratio(df: DataFrame, text: str, view: str, s: Settings) -> DataFrame:
    """Adds llr: the mean over the characters of log p(accepted) - log p(rejected); 0 for an empty text.

    Each model backs off from its longest context: p_n = (count(context, char) + strength * p_(n-1)) /
    (count(context) + strength), and p_(-1) = 1 / alphabet.
    """

    def p(found: Column, side: str) -> Column:
        out = F.lit(1.0 / s.alphabet)
        for n in range(s.order + 1):
            out = (found[2 * n + 1][side] + s.strength * out) / (found[2 * n][side] + s.strength)
        return out

    kept = df.columns
    # the model is named once, inside the lambda, so that it is a constant and not a column of every row
    df = df.select(*kept, grams(text, s).alias("g_"), F.expr(f"(select m from {view})").alias("m_"))
    df = df.select(*kept, F.transform("g_", lambda x: F.transform(x, lambda b: F.col("m_")[b])).alias("f_"))
    total = F.aggregate("f_", F.lit(0.0), lambda a, x: a + F.log(p(x, "a")) - F.log(p(x, "r")))
    return df.select(*kept, F.coalesce(total / F.nullif(F.char_length(F.col(text)), F.lit(0)), F.lit(0.0)).alias("llr"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, s: Settings = Settings()) -> DataFrame:
    """Adds host, path, rule, verdict, llr and basis (`rule` or `model`) to every row.

    All distinct URLs that a rule allows or blocks teach the accepted and the rejected model. Four folds of five train; the fifth sets the threshold under which
    accepted_loss of its accepted URLs lie. URLs without a rule are allowed if llr reaches the threshold; without accepted
    or rejected examples all are. A null url has an empty host and path and goes by the model with llr 0, which the
    threshold is never above. Every row gives one row; clashing columns are replaced.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    new = ("host", "path", "rule", "verdict", "llr", "basis")
    kept = [c for c in pages.columns if c.lower() not in new]
    host, path = host_and_path("url")
    ruled = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("r_", longest_rule(F.col("host"), F.col("path"), rules))
    slim = pages.select("url").where("url is not null").withColumn("r_", longest_rule(*host_and_path("url"), rules)).where("r_ is not null")

    fold = F.pmod(F.xxhash64("url", F.lit(s.seed + 1)), F.lit(s.folds)) == 0
    examples = slim.select("url", (F.col("r_.verdict") == "allow").alias("good")).distinct()
    examples = scratch.save(examples.withColumn("tune", fold), "examples")
    good, bad = examples.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    dealt = examples.where(~F.col("tune")).repartition(-(-(good + bad) // s.rows_per_task) or 1, "url")
    view = f"urls_{uuid.uuid4().hex}"
    scratch.save(counts(dealt, s), "model").createOrReplaceTempView(view)
    tuned = with_ratio(examples.where("tune and good"), "url", view, s).select(F.col("llr").alias("x"))
    cut = min(quantile(scratch.save(tuned, "tuned"), s.accepted_loss) or 0.0, 0.0) if good and bad else float("-inf")
    whole = F.coalesce(F.col("url"), F.lit(""))
    scored = with_ratio(ruled.withColumn("u_", whole), "u_", view, s)
    by_model = F.when(F.col("llr") >= cut, "allow").otherwise("block")
    out = scored.select(
        *kept, "host", "path", F.col("r_.rule").alias("rule"), F.coalesce(F.col("r_.verdict"), by_model).alias("verdict"), "llr",
        F.when(F.col("r_").isNotNull(), "rule").otherwise("model").alias("basis"),
    )
    pages.sparkSession.catalog.dropTempView(view)  # the plan has it
    return out


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, llr for every row of pages."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "llr")
