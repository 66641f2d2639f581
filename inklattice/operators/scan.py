"""The scan of drawings: classes, then topology and layouts of the documents of each class, as tables.

A scan is a chain of steps over named tables.  Steps see the tables made so far; a document's error stays with that
document, in the ``errors`` table, and takes it out of later steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inklattice.operators import classify, drawing, positions, topology
from inklattice.operators.matching import stage_filter
from inklattice.operators.spatial import use_checkpoints

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]


def run_steps(tables: Tables, steps: list[Step]) -> Tables:
    """Each step's tables join those before; rows with an error leave their table for ``errors`` (document_hash, step, error).

    What a step makes is written by a checkpoint, so that later steps and readers do not make it again.
    """
    held = dict(tables)
    use_checkpoints(held["entities"].sparkSession)
    for step in steps:
        live = held
        if "errors" in held:
            bad = held["errors"].select("document_hash").distinct()
            live = {**held, "entities": held["entities"].join(bad, "document_hash", "left_anti")}
        for name, made in step(live).items():
            made = made.checkpoint()
            if "error" in made.columns:
                failed = made.filter("error IS NOT NULL").select("document_hash", F.lit(name).alias("step"), "error")
                held["errors"] = failed if "errors" not in held else held["errors"].unionByName(failed)
                made = made.filter("error IS NULL").drop("error")
            held[name] = made
    return held


def classify_step(t: Tables) -> Tables:
    found = classify.classify_documents(t["entities"])
    return {"classes": found.select("document_hash", F.col("primary").alias("classification"), "confidence", "secondary", "signals")}


def topology_step(t: Tables) -> Tables:
    records = topology.scan_topology(t["entities"], t["classes"])
    return {"topology": records, "regions": topology.scan_cabinet_regions(t["entities"], t["classes"]), "terminals": topology.scan_cabinet_terminals(t["entities"], t["classes"])}


def layout_step(t: Tables) -> Tables:
    """Panel layouts and position plans, each for documents of that class only."""
    own = lambda name: topology.of_class(t["entities"], t["classes"], name)
    return {"layouts": drawing.scan_layout(own("panel_layout")), "positions": positions.scan_position_nodes(own("panel_position"))}


#: The order of a scan.
STEPS: list[Step] = [classify_step, topology_step, layout_step]


def scan(entities: DataFrame) -> Tables:
    return run_steps({"entities": entities}, STEPS)


def scan_summary(tables: Tables) -> DataFrame:
    """One row a document: its class, and how many records, regions and nodes it has; unmatched if its class has no analyzer."""
    count = lambda name: tables[name].groupBy("document_hash").agg(F.count("*").alias(name))
    out = tables["classes"].select("document_hash", "classification")
    for name in ("topology", "regions", "terminals", "layouts", "positions"):
        out = out.join(count(name), "document_hash", "left")
    sums = [F.coalesce(n, F.lit(0)).alias(n) for n in ("topology", "regions", "terminals", "layouts", "positions")]
    return out.select("document_hash", "classification", *sums, (~F.col("classification").isin(list(topology.ANALYZERS))).alias("unmatched"))


# --- progress of stages -------------------------------------------------------------------------------------
# The six recognition stages: name, engine, language, preprocessing.
STAGES = [
    ("chieng_tess", "tesseract", "chi_sim+eng", "none"), ("chieng_tess_gauss", "tesseract", "chi_sim+eng", "gauss"), ("chisim_tess", "tesseract", "chi_sim", "none"), ("chisim_tess_gauss", "tesseract", "chi_sim", "gauss"),
    ("chieng_paddle", "paddle", "chi_sim+eng", "none"), ("chisim_paddle", "paddle", "chi_sim", "none"),
]


def chosen_stages(engine: str = "mixed", spec: str = "all") -> list[tuple[str, str, str, str]]:
    """Stages of an engine choice (mixed: all; tesseract: its own) by a stage filter; paddle alone is no choice."""
    if engine not in ("mixed", "tesseract"):
        raise ValueError(f"no such choice: {engine!r}")
    own = [s for s in STAGES if engine == "mixed" or s[1] == engine]
    return [own[k - 1] for k in stage_filter(spec, len(own))]


def stage_progress(stages: DataFrame, done: DataFrame, matches: DataFrame, total: int) -> DataFrame:
    """Per stage: documents done of all, and matches.  stages: stage; done: stage, document_hash; matches: stage, cable, hash."""
    d = done.groupBy("stage", "document_hash").agg(F.lit(1).alias("_")).groupBy("stage").agg(F.count("*").alias("done"))
    m = matches.groupBy("stage").agg(F.count("*").alias("matches"), F.count_distinct("cable").alias("cables"))
    out = stages.join(d, "stage", "left").join(m, "stage", "left")
    return out.select("stage", F.coalesce("done", F.lit(0)).alias("done"), F.lit(total).cast("long").alias("total"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("cables", F.lit(0)).alias("cables"))
