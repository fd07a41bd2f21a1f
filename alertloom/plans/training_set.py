"""Labelled rows to a split chat dataset."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.dataset import (
    chat_records, degrade_context, inject_adversarial, stratified_split, with_native_class)
from alertloom.operators.prompts import build_user_message, cap_event_json
from alertloom.operators.scoring import rubric_label
from alertloom.schemas import MODEL_OUTPUT
from alertloom.session import stage


def label_rows(rows: DataFrame) -> DataFrame:
    """``classification`` from the native label, else from the rubric; undecided rows drop."""
    has_label = F.coalesce(F.col("native_label"), F.lit("")) != ""
    native = with_native_class(rows)
    return native.withColumn(
        "classification", F.when(has_label, F.col("classification")).otherwise(rubric_label())
    ).where("classification is not null")


def rejected_rows(rows: DataFrame) -> DataFrame:
    """(event_id, reasons) of the rows that ``build_dataset`` leaves out for their content, labels aside."""
    ok = F.size("violations") == 0
    over = cap_event_json(label_rows(rows.where(ok).drop("violations"))).where("oversize")
    return rows.where(~ok).select("event_id", F.col("violations").alias("reasons")).unionByName(
        over.select("event_id", F.array(F.lit("oversize")).alias("reasons")))


def build_dataset(rows: DataFrame, system_prompt: str, seed: int = 42, adversarial_percent: int = 0,
                  degraded_percent: int = 20, rationale: str = "labelled example", staged: bool = True,
                  pick: Column | None = None, pick_bound: int = 2**62) -> DataFrame:
    """(event_id, classification, split, messages) from the rows of a labelled source.

    Rows that break the event contract are left out, as are excluded labels and events
    that no cut brings under the byte cap; ``rejected_rows`` names them.  The split needs the class sizes first, so
    ``staged`` writes the assembled rows once instead of assembling them twice.  ``pick``, a long in
    [0, ``pick_bound``), replaces the seeded hashes that choose and order rows.
    """
    rows = rows if pick is None else rows.withColumn("_pick", pick)
    picked = None if pick is None else F.col("_pick")
    rows = label_rows(rows.where(F.size("violations") == 0).drop("violations"))
    rows = degrade_context(rows, seed, degraded_percent, pick=picked)
    if adversarial_percent:
        draw = F.xxhash64(F.lit(seed + 1), "event_id") if pick is None else F.floor(picked / 100)
        chosen = F.pmod(draw, F.lit(100)) < adversarial_percent
        attacked = inject_adversarial(
            rows.withColumns({"_sig": F.col("signature"), "_cls": F.col("classification")}), seed, pick=picked)
        rows = attacked.withColumns({
            "signature": F.when(chosen, F.col("signature")).otherwise(F.col("_sig")),
            "classification": F.when(chosen, F.col("classification")).otherwise(F.col("_cls")),
        }).drop("_sig", "_cls")
    rows = build_user_message(rows).where("not oversize")
    answered = rows.withColumns({
        "confidence": F.lit(0.9), "summary": F.substring("summary", 1, 200),
        "suggested_actions": F.array().cast("array<string>"), "rationale": F.lit(rationale)})
    answered = answered.select("event_id", "classification", "user_message", *MODEL_OUTPUT.names[1:],
                               *([] if pick is None else ["_pick"]))
    split = stratified_split(stage(answered, "labelled") if staged else answered, seed=seed,
                             order=picked, order_bound=pick_bound)
    return chat_records(split, system_prompt).select("event_id", "classification", "split", "messages")
