"""Anatomical atlas labels: organ ids, sides, model links, the crosswalk table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of

# --- fixed values ---------------------------------------------------------
# Organ id -> folder of its models.
ORGAN_FOLDERS = {
    "pelvis": "ref-organ/pelvis", "left-kidney": "ref-organ/kidney-left", "right-kidney": "ref-organ/kidney-right",
    "heart": "ref-organ/heart", "liver": "ref-organ/liver", "left-knee": "ref-organ/left-knee", "right-knee": "ref-organ/right-knee",
}
# Label -> organ id.
ORGAN_IDS = {
    "Hip": "pelvis", "Knee": "femur-left", "Left Femur": "femur-left", "Right Femur": "femur-right", "Pelvis": "pelvis",
    "Heart": "heart", "Kidney (Left)": "kidney-left", "Kidney (Right)": "kidney-right", "Lung (Left)": "lung-left", "Lung (Right)": "lung-right",
}
# Label -> ontology id.
ONTOLOGY_IDS = {
    "Hip": "http://purl.obolibrary.org/obo/UBERON_0001270", "Knee": "http://purl.obolibrary.org/obo/FMA_24978",
    "Kidney (Left)": "http://purl.obolibrary.org/obo/UBERON_0004538", "Kidney (Right)": "http://purl.obolibrary.org/obo/UBERON_0004539",
    "Pelvis": "http://purl.obolibrary.org/obo/UBERON_0001270", "Heart": "http://purl.obolibrary.org/obo/UBERON_0000948",
}
# Path of the crosswalk between anatomy and models under the atlas root.
CROSSWALK = "ref-organ/asct-b-3d-models-crosswalk/asct-b-3d-models-crosswalk.csv"
# --------------------------------------------------------------------------


def mapped(label: ColumnLike, table: dict[str, str]) -> Column:
    """The id of a label by a fixed dictionary of the code (a literal map); null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), col_of(label))


def organ_id(label: ColumnLike) -> Column:
    return mapped(label, ORGAN_IDS)


def ontology_id(label: ColumnLike) -> Column:
    return mapped(label, ONTOLOGY_IDS)


def side(label: ColumnLike) -> Column:
    """left / right by the word in the label, left first; none otherwise."""
    c = col_of(label)
    return F.when(c.contains("Left"), "left").when(c.contains("Right"), "right").otherwise("none")


def model_url(organ: ColumnLike, sex: ColumnLike, root: str) -> Column:
    """Link of an organ's model; null for an organ without models."""
    c = col_of(organ)
    return F.concat(F.lit(root.rstrip("/") + "/"), mapped(c, ORGAN_FOLDERS), F.lit("/3d-vh-"), col_of(sex), F.lit("-"), c, F.lit(".glb"))


def load_crosswalk(spark: SparkSession, root: str) -> DataFrame | None:
    """The crosswalk table of a staged copy of the atlas; None when it is not there."""
    from matfold.sources.readers import read_csv_if_exists
    return read_csv_if_exists(spark, f"{root.rstrip('/')}/{CROSSWALK}", encoding=None)
