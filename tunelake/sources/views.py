"""Fixture views over the driver tables, as Spark DataFrames.

Each view reproduces one input shape the operators take (instruction rows,
model predictions, preference pairs, token sequences, log-probability
tables, ...) from the given tables only, so every query's work grows with
the tables. The same views exist as SQL for the DuckDB oracle in
``tunelake.plans.oracle_views``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import with_next_values, with_row_number

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

#: Rows that one task of a long-form view sorts and joins at once.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Views:
    """Lazily built views for one (session, data folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def parts(self, name: str) -> int:
        """Partitions for the rows of a table: the session's, or as many as keep TASK_ROWS in one (the files' metadata
        hold the count)."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.t(name).count() // TASK_ROWS))

    # -- instruction data -------------------------------------------------
    def instr(self) -> DataFrame:
        """(row_id, conv_id, instruction, context, response): every user turn
        answered by an assistant turn; context = the system text."""
        conv = self.t("conversations")
        ctx = conv.groupBy("conv_id").agg(
            F.coalesce(F.max(F.when(F.col("role") == "system", F.col("text"))),
                       F.lit("")).alias("context"))
        linked = with_next_values(conv, "turn", ["role", "text"], part_cols=["conv_id"])
        return (linked.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
                .join(ctx, "conv_id")
                .select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "conv_id",
                        F.col("text").alias("instruction"), "context",
                        F.col("next_text").alias("response")))

    def preds(self) -> DataFrame:
        """(row_id, model, instruction, reference, prediction) for three stub
        models; long form so one plan serves all models."""
        i = self.instr().withColumn(
            "model", F.explode(F.array(F.lit("half"), F.lit("echo"), F.lit("mix"))))
        raw = (F.when(F.col("model") == "half",
                      F.expr("substring(response, 1, cast(floor(length(response) / 2.0) as int))"))
               .when(F.col("model") == "echo", F.col("instruction"))
               .otherwise(F.concat(F.substring("response", 1, 60), F.lit(" "), F.col("instruction"))))

        def clean(c):
            return F.trim(F.translate(c, "\n\r", "  "))

        return i.select("row_id", "model", clean(F.col("instruction")).alias("instruction"),
                        clean(F.col("response")).alias("reference"), clean(raw).alias("prediction"))

    def pref(self) -> DataFrame:
        """(row_id, prompt, chosen, rejected): rejected = next row's response."""
        i = self.instr().select("row_id", "instruction", "response")
        nxt = with_next_values(i, "row_id", ["response"])
        return nxt.select("row_id", F.col("instruction").alias("prompt"),
                          F.col("response").alias("chosen"),
                          F.coalesce(F.col("next_response"), F.col("instruction")).alias("rejected"))

    def unpaired(self) -> DataFrame:
        p = self.pref()
        e = p.select("row_id", "prompt", F.explode(F.array(
            F.struct(F.lit(0).alias("k"), F.col("chosen").alias("completion"), F.lit(True).alias("label")),
            F.struct(F.lit(1).alias("k"), F.col("rejected").alias("completion"), F.lit(False).alias("label")),
        )).alias("u"))
        return e.select((F.col("row_id") * 2 + F.col("u.k")).alias("row_id"), "prompt",
                        F.col("u.completion").alias("completion"), F.col("u.label").alias("label"))

    def steps(self) -> DataFrame:
        return (self.t("conversations").where(F.col("role") == "assistant")
                .select("conv_id", F.col("turn").alias("step"), F.col("text").alias("completion"),
                        (F.length("text") % 2).cast("bigint").alias("label")))

    # -- sequences and log-probabilities ------------------------------------
    def seq(self) -> DataFrame:
        """Long-form token table (seq_id, pos, token_id, logp, ref_logp, val,
        score); pos is the 0-based position inside the order."""
        li = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                        "l_discount", "l_tax", "l_quantity")
        o = self.t("orders").select("o_orderkey", "o_totalprice")
        # the key is unique from sf0.01 up; the value columns break the rare ties
        n = self.parts("lineitem")
        li = with_row_number(li, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"],
                             ["l_orderkey"], out="pos", num_partitions=n)
        return (li.repartition(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("l_orderkey").alias("seq_id"), F.col("pos").cast("bigint").alias("pos"),
                        (F.col("l_partkey") % 1000).cast("bigint").alias("token_id"),
                        F.log(F.lit(0.05) + F.col("l_discount")).alias("logp"),
                        F.log(F.lit(0.05) + F.col("l_tax")).alias("ref_logp"),
                        (F.log(F.col("l_quantity") + 1) / 4).alias("val"),
                        (F.log(F.col("o_totalprice")) - 11).alias("score")))

    def pair_logp(self) -> DataFrame:
        return self.t("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.log(F.lit(0.05) + F.col("l_discount")).alias("chosen_logp"),
            F.log(F.lit(0.05) + F.col("l_tax")).alias("rejected_logp"),
            (F.log(F.col("l_quantity") + 1) / 10).alias("margin"))

    def unp_logp(self) -> DataFrame:
        return self.t("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.floor(F.col("l_orderkey") / 100.0).cast("bigint").alias("batch_id"),
            F.log(F.lit(0.05) + F.col("l_discount")).alias("policy_logp"),
            F.log(F.lit(0.05) + F.col("l_tax")).alias("reference_logp"),
            F.log(F.col("l_quantity") / 60).alias("policy_kl_logp"),
            F.log((51 - F.col("l_quantity")) / 60).alias("reference_kl_logp"),
            (F.col("l_returnflag") != "R").alias("label"))

    def steplog(self) -> DataFrame:
        return self.t("events").select(
            F.col("event_id").alias("step"),
            F.floor(F.col("event_id") / 100.0).cast("bigint").alias("epoch"),
            (F.col("user_id") % 4).alias("inner_epoch"),
            F.col("event_type").alias("metric"), F.log(F.col("value") + 1).alias("val"), "ts",
            F.when(F.col("event_id") % 10 == 0, "eval").otherwise("train").alias("mode"))

    def emb_tokens(self) -> DataFrame:
        return self.t("embeddings").select(
            "vec_id", F.floor(F.col("vec_id") / 10.0).cast("bigint").alias("example_id"),
            F.when(F.col("vec_id") % 10 < 5, "pred").otherwise("ref").alias("side"),
            "embedding", (F.col("label") < 5).alias("desirable"))

    def bench(self) -> DataFrame:
        return self.t("events").select(
            "event_id", F.col("event_type").alias("model"), F.col("user_id").alias("prompt_id"),
            F.col("value").alias("latency_s"),
            F.get_json_object("props", "$.k").cast("bigint").alias("gen_tokens"),
            F.log(F.col("value") + 1).alias("reward"), "ts")

    def grid(self) -> DataFrame:
        from ..operators.report import param_grid

        return param_grid(self.spark)

    def grid_runs(self) -> DataFrame:
        g = self.grid().select(
            "run", "r", "alpha", "lr",
            (F.when(F.col("r") == 8, 0).when(F.col("r") == 16, 4).otherwise(8)
             + F.when(F.col("alpha") == F.col("r"), 0).otherwise(2)
             + F.when(F.col("lr_tag") == "00001", 0).otherwise(1)).alias("idx"))
        p = (self.t("part").groupBy(
                (F.col("p_partkey") % 12).alias("idx"),
                F.when(F.floor(F.col("p_partkey") / 12.0).cast("bigint") % 2 == 0, "U")
                .otherwise("P").alias("toolkit"))
             .agg(F.avg(F.log("p_retailprice")).alias("eval_loss"),
                  F.max(F.log(F.col("p_size") + 1.0)).alias("time_min"),
                  F.min(F.log("p_retailprice")).alias("peak_vram")))
        # the grid side has 12 rows by construction: broadcast is size-proven
        return p.join(F.broadcast(g), "idx").select(
            "run", "r", "alpha", "lr", "toolkit", "eval_loss", "time_min", "peak_vram")
