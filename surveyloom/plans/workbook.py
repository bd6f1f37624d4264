"""The six analyses on the survey's own tables.

``tables`` maps a sheet name to its DataFrame, as ``surveyloom.sources.tables.load_all``
returns it for a folder with one Parquet or CSV table per sheet. Joins on the
respondent key treat two missing keys as equal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom import domain as d
from surveyloom.functions.levels import answer_level, ordinal
from surveyloom.functions.text import percent_label
from surveyloom.operators import likert
from surveyloom.operators.columns import apply_columns, name_range, named, names_at, select_range
from surveyloom.operators.counts import count_rows
from surveyloom.operators.joins import literal_table
from surveyloom.operators.losses import Losses
from surveyloom.operators.points import bounding_box, rescale_area
from surveyloom.operators.rows import censor
from surveyloom.plans import survey

Tables = Mapping[str, DataFrame]


def _places(tables: Tables) -> survey.Places:
    return survey.Places(tables["A_perfil"], "ID", "cofradia", d.ZONES, "otro", "zona", null_safe=True)


def _labelled(df: DataFrame, item_range: tuple[str, str], labels: Sequence[str]) -> dict[str, str]:
    """Item columns of a block, with their printed labels."""
    return dict(zip(name_range(df, *item_range), labels, strict=True))


def coverage(tables: Tables, inventory: str = "emb_inv_2022") -> DataFrame:
    """Percent of the fleet interviewed at each port; ``trip_inv_2022`` gives the crew.

    ``size`` is the size of the port's mark, whose area grows with all its interviews.
    """
    bands = survey.coverage_bands(tables["00_entrevistas"], "x", "y", "n_emb", inventory, keep=["entrevistas_tot"])
    return rescale_area(bands, "entrevistas_tot", "size", *d.MARK_SIZES)


def coverage_box(tables: Tables) -> DataFrame:
    """The box around all ports."""
    return bounding_box(tables["00_entrevistas"], "x", "y")


def interviews_per_zone(tables: Tables) -> DataFrame:
    return count_rows(_places(tables).attach(tables["E_ambiental"]), "zona", name="recuento")


def conflict_answers(tables: Tables) -> DataFrame:
    """Zone and the recoded conflict items, as a clean table to be written out."""
    zoned = _places(tables).attach(tables["E_ambiental"])
    frame = select_range(zoned, ["zona"], *d.CONFLICT_RANGE)
    return apply_columns(frame, frame.columns[1:], answer_level(d.CONFLICT_ANSWERS, d.CONFLICT_LEVELS))


def conflict_counts(tables: Tables, theme: str | None = None, by_zone: bool = True) -> DataFrame:
    """Level counts of the conflict items, or of one theme's items."""
    answers = tables["E_ambiental"]
    labels = _labelled(answers, d.CONFLICT_RANGE, d.CONFLICT_LABELS)
    items = list(labels)
    if theme is not None:
        items = names_at(answers.select("ID", *[named(i) for i in items]), d.CONFLICT_THEMES[theme])
    if not by_zone:
        return likert.level_counts(answers, items, d.CONFLICT_LEVELS, [], labels, d.CONFLICT_ANSWERS)
    return survey.likert_by_zone(answers, _places(tables), items, d.CONFLICT_ANSWERS, d.CONFLICT_LEVELS, labels)


def change_counts(tables: Tables, by_zone: bool = True) -> DataFrame:
    """Level counts of the environment items."""
    answers = tables["E_ambiental"]
    labels = _labelled(answers, d.CHANGE_RANGE, d.CHANGE_LABELS)
    if not by_zone:
        return likert.level_counts(answers, list(labels), d.CHANGE_LEVELS, [], labels, d.CHANGE_ANSWERS)
    return survey.likert_by_zone(answers, _places(tables), list(labels), d.CHANGE_ANSWERS, d.CHANGE_LEVELS, labels)


def in_item_order(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Adds position, the place of the item in its charts from 1."""
    return df.withColumn("position", ordinal(F.col("item"), items))


def likert_tables(counts: DataFrame, levels: Sequence[str], bandwidth: float | None = None) -> dict[str, DataFrame]:
    """All summaries behind the Likert charts of one block; without a bandwidth the answers give their own."""
    k = len(levels)
    grid = [1 + i * (k - 1) / 100 for i in range(101)]
    return {
        "shares": likert.level_shares(counts, levels),
        "balance": likert.low_neutral_high(counts, k),
        "spread": likert.mean_sd(counts, k),
        "bars": likert.centered_offsets(counts, levels),
        "density": likert.ordinal_density(counts, k, grid, bandwidth),
    }


def heatmaps(tables: Tables) -> DataFrame:
    """Zone by level cells of all environment items, with the printed label."""
    answers = tables["E_ambiental"]
    labels = _labelled(answers, d.CHANGE_RANGE, d.CHANGE_LABELS)
    cells = survey.heatmap_cells(answers, _places(tables), list(labels), d.CHANGE_ANSWERS, d.CHANGE_LEVELS, labels)
    return cells.withColumn("label", percent_label(F.col("percent")))


def species(tables: Tables, shortlist: bool = False, losses: Losses | None = None) -> DataFrame:
    """Signed percent of each listed species and zone."""
    reports = tables["C_especies"]
    respondents = literal_table(reports.sparkSession, "zona string, respondents long", d.RESPONDENTS)
    return survey.species_change(reports, _places(tables), respondents, "sp_cien", "abundancia", d.ABUNDANCE,
                                 d.SPECIES, "respondents", shortlist=d.SHORTLIST if shortlist else None, losses=losses)


def species_bars(tables: Tables, losses: Losses | None = None) -> DataFrame:
    """The bars of ``species`` that lie inside the limits of the chart."""
    return censor(species(tables, losses=losses), "percent", *d.SPECIES_LIMITS, losses, "species bars")


def contradictions(tables: Tables) -> DataFrame:
    """Species reported both falling and rising in one zone."""
    return survey.contradictory_species(tables["C_especies"], _places(tables), "sp_cien", "abundancia", "menor", "mayor")


def unlisted_species(tables: Tables) -> DataFrame:
    """Reports of species outside the list, which the shares leave out."""
    return survey.species_outside(tables["C_especies"], "sp_cien", list(d.SPECIES))


def rotation(tables: Tables, added_rows_keep_zone: bool = True, losses: Losses | None = None) -> DataFrame:
    """Share of each gear by zone and month, with the gear's place in the legend.

    The sheet holds the hand line twice; where the repeated header got its position
    as a suffix, the column at position 11 is the one to keep.
    """
    trips = tables["B_rotacion"].withColumnRenamed("linea_mano_11", "linea_mano")
    trips = trips.select("ID", "mes", *[named(g) for g in d.GEARS])
    shares = survey.gear_rotation(trips, _places(tables), "mes", list(d.GEARS), d.MONTHS, gear_labels=d.GEARS,
                                  no_fishing=d.NO_FISHING, added_rows_keep_zone=added_rows_keep_zone, losses=losses)
    return shares.withColumn("ordinal", ordinal(F.col("fishing_method"), d.GEAR_LEVELS))


def donut_answers(tables: Tables) -> DataFrame:
    """The climate-effect questions with the zone, as a clean table to be written out."""
    asked = ["Q19_efecto_now", "Q19_efecto_now_tipo", "Q19_efecto_now_exp", "Q20_efecto_fut",
             "Q20_efecto_fut_tipo", "Q20_efecto_fut_exp", "Q22_cc_sp", "Q22_cc_sp_exp", "Q23_cc_now",
             "Q23_cc_now_exp", "Q24_cc_fut", "Q24_cc_fut_exp"]
    return _places(tables).attach(tables["E_ambiental"].select("ID", *asked)).select("ID", *asked, "cofradia", "zona")


def donuts(tables: Tables) -> DataFrame:
    """Shares of the present climate effects and their kinds by zone."""
    answers = tables["E_ambiental"].select("ID", "Q19_efecto_now", "Q19_efecto_now_tipo")
    return survey.pie_donut_by_zone(answers, _places(tables), "Q19_efecto_now", "Q19_efecto_now_tipo",
                                    of_whole=d.DONUTS_OF_WHOLE)


def results(tables: Tables, losses: Losses | None = None) -> dict[str, DataFrame]:
    """One table per analysis.

    With ``losses``, what the species bars and the rotation leave out is known as soon as these
    two have been written: ``losses.report`` gives it as a table.
    """
    return {
        "coverage_fleet": coverage(tables),
        "coverage_crew": coverage(tables, "trip_inv_2022"),
        "coverage_box": coverage_box(tables),
        "interviews_per_zone": interviews_per_zone(tables),
        "conflicts": in_item_order(likert.level_shares(conflict_counts(tables), d.CONFLICT_LEVELS), d.CONFLICT_LABELS),
        "changes": in_item_order(likert.level_shares(change_counts(tables), d.CHANGE_LEVELS), d.CHANGE_ORDER),
        "heatmaps": in_item_order(heatmaps(tables), d.CHANGE_ORDER),
        "species": species(tables),
        "species_bars": species_bars(tables, losses),
        "species_shortlist": species(tables, shortlist=True),
        "contradictory_species": contradictions(tables),
        "species_outside_list": unlisted_species(tables),
        "rotation": rotation(tables, losses=losses),
        "donuts": donuts(tables),
    }
