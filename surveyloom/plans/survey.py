"""The six analyses over any tables; column names, lists and bounds are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.levels import (
    Groups,
    band,
    mirror,
    ratio,
    raw_answers,
    relabel,
    rollup,
)
from surveyloom.operators.columns import flag_empty_rows, named, row_sum
from surveyloom.operators.counts import count_rows, sum_or_zero
from surveyloom.operators.grids import explode_domain
from surveyloom.operators.joins import left_join
from surveyloom.operators.likert import add_codes, code_answers, count_codes, counts_of_items, level_shares
from surveyloom.operators.losses import Losses, watched
from surveyloom.operators.rows import drop_na_text, keep_in
from surveyloom.operators.shares import pie_donut


@dataclass(frozen=True)
class Places:
    """Where respondents belong: a profile with their place, and the zones of places."""

    profile: DataFrame
    key: str
    place: str
    zones: Groups
    default: str
    zone: str
    null_safe: bool = False

    def zone_of(self) -> DataFrame:
        """Key, place and zone; rolled up once per respondent and not per answer."""
        place = named(self.place)
        return self.profile.select(named(self.key), place, rollup(place, self.zones, self.default).alias(self.zone))

    def attach(self, answers: DataFrame) -> DataFrame:
        """Add place and zone to each answer; without a profile the zone is the default."""
        joined = left_join(answers, self.zone_of(), self.key, self.null_safe)
        return joined.withColumn(self.zone, F.coalesce(named(self.zone), F.lit(self.default)))

    def attach_counted(self, counted: DataFrame, weight: str) -> DataFrame:
        """Add zone and weight to rows that hold the counts of one respondent each.

        The weight is the number of profile rows the respondent has in the zone, as a row
        of answers would be joined to each of them; without a profile it is 1.
        """
        key, zone = named(self.key), named(self.zone)
        times = self.zone_of().groupBy(key, zone).agg(F.count(F.lit(1)).alias(weight))
        joined = left_join(counted, times, self.key, self.null_safe)
        return joined.withColumns({self.zone: F.coalesce(zone, F.lit(self.default)),
                                   weight: F.coalesce(named(weight), F.lit(1))})


def coverage_bands(sites: DataFrame, x: str, y: str, part: str, whole: str,
                   low: float = 20.0, high: float = 30.0, keep: Sequence[str] = ()) -> DataFrame:
    """Percent covered at each site, with its band, and the columns of ``keep``."""
    percent = ratio(named(part), named(whole))
    return (sites.select(named(x).alias("x"), named(y).alias("y"), named(part).alias("n"),
                         named(whole).alias("total"), percent.alias("percent"), *[named(k) for k in keep])
            .withColumn("band", band(F.col("percent"), low, high)))


def likert_by_zone(answers: DataFrame, places: Places, items: Sequence[str], mapping: Mapping[str, str],
                   levels: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Level counts by zone and item; a missing answer is left out of its own item only."""
    coded = code_answers(answers.select(named(places.key), *[named(i) for i in items]), items, levels, mapping)
    return _counts_by_zone(coded, places, items, len(levels), labels)


def _counts_by_zone(coded: DataFrame, places: Places, items: Sequence[str], k: int,
                    labels: Mapping[str, str] | None) -> DataFrame:
    """Level counts by zone and item; answers are counted per respondent before the profile is joined.

    What is shuffled for the join is one row of counters per respondent and task, so a
    respondent with a third of all answers is a few rows; the join itself meets one row each.
    """
    counted = count_codes(coded, items, k, [places.key])
    summed = add_codes(places.attach_counted(counted, "__times"), items, k, [places.zone], "__times")
    return counts_of_items(summed, items, k, [places.zone], labels)


def heatmap_cells(answers: DataFrame, places: Places, items: Sequence[str], mapping: Mapping[str, str],
                  levels: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Zone by level cells of every item, from respondents who answered all items."""
    listed = [raw for raws in raw_answers(mapping, levels).values() for raw in raws]
    complete = answers.select(named(places.key), *[named(i) for i in items])
    for item in items:  # on the raw answers, so that the test reaches the scan
        complete = complete.filter(named(item).isin(listed))
    coded = code_answers(complete, items, levels, mapping)
    return level_shares(_counts_by_zone(coded, places, items, len(levels), labels), levels, n="count")


def species_change(reports: DataFrame, places: Places, denominators: DataFrame, species: str, direction: str,
                   mapping: Mapping[str, str], listed: Sequence[str], total: str,
                   down: str = "Decrease", up: str = "Increase",
                   shortlist: Sequence[str] | None = None, losses: Losses | None = None) -> DataFrame:
    """Signed percent of respondents who saw each listed species fall or rise.

    ``denominators`` holds the respondents per zone and decides which zones appear.
    Every listed species has a row, also if nobody named it; others are left out.
    ``losses`` counts the reports without a species or direction, and those of species that
    are not listed, while the result is made.
    """
    zone = places.zone
    wanted = list(listed) if shortlist is None else [s for s in listed if s in set(shortlist)]
    changed = [raw for raw, new in mapping.items() if new in (down, up)]
    named_both = (named(species) != "NA") & (named(direction) != "NA")
    seen = watched(losses, reports, "species", {
        "no species or direction": ~F.coalesce(named_both, F.lit(False)),
        "species not listed": named_both & ~named(species).isin(list(listed))})
    reported = keep_in(keep_in(drop_na_text(seen, species, direction), species, wanted), direction, changed)
    way = relabel(named(direction), mapping)
    per_respondent = reported.groupBy(named(places.key), named(species)).agg(
        F.count_if(way == down).alias("__down"), F.count_if(way == up).alias("__up"))
    counts = places.attach(per_respondent).groupBy(named(zone), named(species)).agg(
        F.sum("__down").alias("__down"), F.sum("__up").alias("__up"))
    grid = explode_domain(denominators.select(named(zone), named(total)), species, wanted)
    cells = left_join(grid, counts, [zone, species])

    def bar(label: str, n: str) -> Column:
        percent = ratio(F.coalesce(F.col(n), F.lit(0)), named(total))
        return F.struct(F.lit(label).alias(direction),
                        mirror(percent, F.lit(label), negative=down).alias("percent"))

    return cells.select(named(zone), named(species),
                        F.inline(F.array(bar(down, "__down"), bar(up, "__up"))))


def _months_of_keys(trips: DataFrame, key: str, month: str, gears: Sequence[str], domain: Sequence[str]) -> DataFrame:
    """Per key an array of (month, present, gear sums, rows without gear), with an entry for each month of the domain.

    A key's rows are summed by month before its months are gathered, so no array is
    longer than the domain. Other months give no entry, but leave their key a row.
    """
    empty = "__none"
    listed = trips.withColumn(month, F.when(named(month).isin(list(domain)), named(month)))
    cells = sum_or_zero(flag_empty_rows(listed, gears, empty), [key, month], [*gears, empty])
    types = {f.name: f.dataType for f in cells.schema}
    found = F.struct(F.lit(True).alias("present"), *[named(c) for c in (*gears, empty)])
    none = F.struct(F.lit(False).alias("present"), *[F.lit(0).cast(types[g]).alias(g) for g in gears],
                    F.lit(1).cast(types[empty]).alias(empty))
    by_month = F.map_from_entries(F.collect_list(F.when(named(month).isNotNull(), F.struct(named(month), found))))
    per_key = cells.groupBy(named(key)).agg(by_month.alias("__found"))
    entries = [F.struct(F.lit(m).alias(month), F.coalesce(F.try_element_at("__found", F.lit(m)), none).alias("__cell"))
               for m in domain]
    return per_key.select(named(key), F.array(*entries).alias("__months"))


def _zones_of_keys(places: Places) -> DataFrame:
    """Per key its zones, each with its number of profile rows, and the number of all of them: one row for each key."""
    key, zone = named(places.key), named(places.zone)
    per_zone = places.zone_of().groupBy(key, zone).agg(F.count(F.lit(1)).alias("n"))
    return per_zone.groupBy(key).agg(F.collect_list(F.struct(zone.alias("zone"), F.col("n"))).alias("__zones"),
                                     F.sum("n").alias("__profiles"))


def gear_rotation(trips: DataFrame, places: Places, month: str, gears: Sequence[str], months: Mapping[str, str],
                  gear_labels: Mapping[str, str] | None = None, no_fishing: str = "No Fishing",
                  added_rows_keep_zone: bool = True, losses: Losses | None = None) -> DataFrame:
    """Share of each gear by zone and month, with a "no fishing" share.

    Each respondent gets a row for every month; a month without any gear counts as
    "no fishing". With ``added_rows_keep_zone=False`` the rows added for months
    without data stay in the NULL zone, as the zone came with the trips, and the
    profile is looked up twice: a respondent with several profile rows counts that
    often again.

    The trips are read once and summed per respondent and month before anything is
    joined. Several profile rows are a weight of the sums, not more rows. ``losses``
    counts the trips of months that are not listed, on the same read.
    """
    key, zone = places.key, places.zone
    trips = watched(losses, trips, "rotation", {"month not listed": relabel(named(month), months).isNull()})
    labelled = trips.withColumn(month, relabel(named(month), months))
    per_key = _months_of_keys(labelled, key, month, gears, list(months.values()))
    joined = left_join(per_key, _zones_of_keys(places), key, places.null_safe)
    one = F.lit(1).cast("long")
    own = F.coalesce(F.col("__zones"), F.array(F.struct(F.lit(places.default).alias("zone"), one.alias("n"))))
    if added_rows_keep_zone:
        shares = F.transform(own, lambda z: F.struct(z["zone"].alias("zone"), z["n"].alias("n"), F.lit(None).cast("boolean").alias("of")))
    else:
        profiles = F.coalesce("__profiles", one)
        shares = F.concat(
            F.transform(own, lambda z: F.struct(z["zone"].alias("zone"), (z["n"] * profiles).alias("n"), F.lit(True).alias("of"))),
            F.array(F.struct(F.lit(None).cast("string").alias("zone"), profiles.alias("n"), F.lit(False).alias("of"))))
    placed = joined.select("__months", F.explode(shares).alias("__z")).select("__z", F.inline("__months"))
    placed = placed.filter(F.coalesce(F.col("__z.of") == F.col("__cell.present"), F.lit(True)))

    methods = [*gears, "__none"]
    weighted = placed.select(F.col("__z.zone").alias(zone), named(month),
                             *[(F.col("__cell").getField(m) * F.col("__z.n")).alias(m) for m in methods])
    sums = sum_or_zero(weighted, [zone, month], methods)
    names = {**{g: g for g in gears}, **(gear_labels or {}), "__none": no_fishing}
    totals = sums.withColumn("total", row_sum(methods))
    rows = [F.struct(F.lit(names[m]).alias("fishing_method"), named(m).alias("total_value"),
                     F.col("total"), ratio(named(m), F.col("total")).alias("percent"))
            for m in methods]
    return totals.select(named(zone), named(month), F.inline(F.array(*rows)))


def pie_donut_by_zone(answers: DataFrame, places: Places, answer: str, sub_answer: str,
                      of_whole: Sequence[str] = ()) -> DataFrame:
    """Shares of answers and sub-answers per zone.

    Zones in ``of_whole`` show the outer share of the whole zone, others within the answer.
    """
    zone = named(places.zone)
    within = ~F.coalesce(zone.isin(list(of_whole)), F.lit(False)) if of_whole else True
    counted = count_rows(drop_na_text(answers, answer), places.key, answer, sub_answer, name="__count")
    return pie_donut(places.attach(counted), [places.zone], answer, sub_answer, within, counted="__count")


def contradictory_species(reports: DataFrame, places: Places, species: str, direction: str, down: str,
                          up: str) -> DataFrame:
    """Species that a zone's respondents report both falling and rising, with the reports of either kind.

    Reports are counted per respondent before the join to the zones.
    """
    way = named(direction)
    counted = drop_na_text(reports, species).groupBy(named(places.key), named(species)).agg(
        F.count_if(way == down).alias("__down"), F.count_if(way == up).alias("__up"))
    zoned = places.attach(counted).groupBy(named(places.zone), named(species)).agg(
        F.sum("__down").alias("n_down"), F.sum("__up").alias("n_up"))
    return zoned.filter("n_down > 0 and n_up > 0")


def species_outside(reports: DataFrame, species: str, listed: Sequence[str]) -> DataFrame:
    """Reported species that the list lacks, with their reports: what ``species_change`` leaves out."""
    named_reports = drop_na_text(reports, species)
    return count_rows(named_reports.filter(~named(species).isin(list(listed))), species)
