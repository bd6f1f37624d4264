"""The six analyses on small invented tables, against plain loops over their rows."""

import random
from collections import defaultdict

import pytest

from surveyloom import domain as d
from surveyloom.operators import likert as lk
from surveyloom.operators.losses import Losses
from surveyloom.operators.rows import censor
from surveyloom.plans import workbook as wb

PORTS = ["Andratx", "Pollença", "Palma", "Alcudia", "Eivissa", "Mao", "Pollenca", None]
CHANGES = [*d.CHANGE_ANSWERS, "NA", "otra cosa", None, "Increase"]
CONFLICTS = [*d.CONFLICT_ANSWERS, "NS/NC", None, "NA"]
ITEMS19 = ["Q19a_oaire", *[f"q19_{i:02d}" for i in range(2, 11)], "Q19k_estaciones"]
ITEMS21 = ["Q21a_profesional", *[f"q21_{i:02d}" for i in range(2, 13)], "Q21m_turismo"]
DONUT = ["Q19_efecto_now", "Q19_efecto_now_tipo", "Q19_efecto_now_exp", "Q20_efecto_fut", "Q20_efecto_fut_tipo",
         "Q20_efecto_fut_exp", "Q22_cc_sp", "Q22_cc_sp_exp", "Q23_cc_now", "Q23_cc_now_exp", "Q24_cc_fut",
         "Q24_cc_fut_exp"]


def zone_of(port):
    return next((z for z, ports in d.ZONES.items() if port in ports), "otro")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    # respondent 1 is in the profile twice; respondents 41 and 42 are not; one key is missing on both sides
    profile = [(i, rng.choice(PORTS)) for i in range(1, 41)] + [(1, "Mao"), (None, "Palma")]
    ids = [*range(1, 43), None]
    ambiental = [(i, *[rng.choice(CHANGES[:5] * 4 + CHANGES) for _ in ITEMS19], *[rng.choice(CONFLICTS) for _ in ITEMS21],
                  rng.choice(["si", "no", "NA", None]), rng.choice(["mas", "menos", "NA", None]), *[None] * 10) for i in ids]
    names = [*d.SPECIES[:12], "Dactylopterus volitans ", "Dactylopterus volitans", "Unknown fish", "NA", None]
    especies = [(rng.choice(ids), rng.choice(names), rng.choice([*d.ABUNDANCE, "NA", None, "otro"])) for _ in range(400)]
    months = [*d.MONTHS, "brumario", None]
    rotacion = [(rng.choice(ids[:30] + [None]), "boat", rng.choice(months),
                 *[rng.choice([None, 0.0, 0.0, 1.0, 2.0]) if rng.random() < .3 else None for _ in d.GEARS], 99.0)
                for _ in range(150)]
    return {"A_perfil": profile, "E_ambiental": ambiental, "C_especies": especies, "B_rotacion": rotacion,
            "00_entrevistas": [(1.0, 39.0, 1.0, 5.0, 0.0, 3.0), (2.0, 39.5, 3.0, 10.0, 20.0, 4.0),
                               (3.0, 38.9, 31.0, 100.0, 200.0, 5.0), (4.0, 40.0, None, 10.0, 10.0, 1.0)]}


@pytest.fixture(scope="module")
def tables(spark, data):
    text = lambda names: ", ".join(f"`{n}` string" for n in names)
    gears = [("linea_mano_11" if g == "linea_mano" else g) for g in d.GEARS]
    schemas = {
        "A_perfil": "ID int, cofradia string",
        "E_ambiental": f"ID int, {text(ITEMS19)}, {text(ITEMS21)}, {text(DONUT)}",
        "C_especies": "ID int, sp_cien string, abundancia string",
        "B_rotacion": f"ID int, nom_embarcacion string, mes string, {', '.join(f'{g} double' for g in gears)}, linea_mano_21 double",
        "00_entrevistas": "x double, y double, n_emb double, emb_inv_2022 double, trip_inv_2022 double, entrevistas_tot double",
    }
    return {name: spark.createDataFrame(data[name], schema) for name, schema in schemas.items()}


def joined(data, sheet):
    """Rows of a sheet with the zone; keys that are both missing match, double keys repeat rows."""
    ports = defaultdict(list)
    for i, port in data["A_perfil"]:
        ports[i].append(port)
    return [(row, zone_of(port)) for row in data[sheet] for port in ports.get(row[0], [None])]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def check(df, keys, values, expected):
    got = {tuple(r[k] for k in keys): tuple(r[v] for v in values) for r in df.collect()}
    assert set(got) == set(expected)
    for key, row in expected.items():
        assert all(close(x, y) for x, y in zip(got[key], row, strict=True)), (key, got[key], row)


def test_coverage(tables, rows):
    got = {r.x: (r.percent, r.band) for r in wb.coverage(tables).collect()}
    assert got == {1.0: (20.0, "yellow"), 2.0: (30.0, "yellow"), 3.0: (31.0, "green"), 4.0: (None, None)}
    sized = {r.x: (r.entrevistas_tot, r.size) for r in wb.coverage(tables).collect()}
    assert sized[4.0] == (1.0, 3.0) and sized[3.0] == (5.0, 10.0) and abs(sized[1.0][1] - (3 + 7 * 0.5 ** 0.5)) < 1e-12
    assert rows(wb.coverage_box(tables)) == [(1.0, 38.9, 4.0, 40.0)]
    crew = {r.x: (r.percent, r.band) for r in wb.coverage(tables, "trip_inv_2022").collect()}
    assert crew == {1.0: (None, None), 2.0: (15.0, "red"), 3.0: (15.5, "red"), 4.0: (None, None)}


def test_interviews_per_zone(tables, data):
    expected = defaultdict(int)
    for _, zone in joined(data, "E_ambiental"):
        expected[zone] += 1
    check(wb.interviews_per_zone(tables), ["zona"], ["recuento"], {(z,): (n,) for z, n in expected.items()})
    assert expected["otro"] > 0


def level_cells(data, first, mapping, levels, labels, listwise):
    cells = defaultdict(lambda: [0] * len(levels))
    for row, zone in joined(data, "E_ambiental"):
        answers = [mapping.get(a, a) for a in row[first:first + len(labels)]]
        answers = [a if a in levels else None for a in answers]
        if listwise and None in answers:
            continue
        for label, answer in zip(labels, answers, strict=True):
            cells[zone, label]
            if answer is not None:
                cells[zone, label][levels.index(answer)] += 1
    return {(zone, label, level): (n[i], n[i] / sum(n) * 100 if sum(n) else None)
            for (zone, label), n in cells.items() for i, level in enumerate(levels)}


def test_conflicts(tables, data):
    expected = level_cells(data, 12, d.CONFLICT_ANSWERS, d.CONFLICT_LEVELS, d.CONFLICT_LABELS, listwise=False)
    shares = lk.level_shares(wb.conflict_counts(tables), d.CONFLICT_LEVELS)
    check(shares, ["zona", "item", "level"], ["n", "percent"], expected)


def test_conflict_themes(tables):
    chosen = {theme: {r.item for r in wb.conflict_counts(tables, theme).collect()} for theme in d.CONFLICT_THEMES}
    assert chosen["other fisheries"] == set(d.CONFLICT_LABELS[:4])
    assert chosen["non-extractive recreation"] == {*d.CONFLICT_LABELS[4:8], "Beach Users", "Tourism"}
    assert chosen["development"] == set(d.CONFLICT_LABELS[8:11])


def test_changes_and_heatmaps_use_different_denominators(tables, data):
    args = (data, 1, d.CHANGE_ANSWERS, d.CHANGE_LEVELS, d.CHANGE_LABELS)
    per_item, listwise = level_cells(*args, listwise=False), level_cells(*args, listwise=True)
    assert per_item != listwise
    check(lk.level_shares(wb.change_counts(tables), d.CHANGE_LEVELS), ["zona", "item", "level"], ["n", "percent"], per_item)
    cells = wb.heatmaps(tables)
    check(cells, ["zona", "item", "level"], ["count", "percent"], listwise)
    assert all(r.label == "%.1f%%" % r.percent for r in cells.collect())


def test_likert_tables_agree(tables):
    views = wb.likert_tables(wb.change_counts(tables, by_zone=False), d.CHANGE_LEVELS)
    for r in views["balance"].collect():
        assert r.low is None or abs(r.low + r.neutral + r.high - 100) < 1e-9
    widths = defaultdict(float)
    for r in views["bars"].collect():
        widths[r.item] += r.bar_end - r.bar_start
    assert all(abs(w - 100) < 1e-9 for w in widths.values()) and set(widths) == set(d.CHANGE_LABELS)
    assert views["density"].count() == 101 * len(d.CHANGE_LABELS)
    assert views["spread"].filter("n > 1 and sd is null").count() == 0


def test_species(tables, data):
    seen = defaultdict(int)
    for (_, name, abundance), zone in joined(data, "C_especies"):
        seen[zone, name, d.ABUNDANCE.get(abundance)] += 1
    expected = {(zone, name, way): (sign * seen[zone, name, way] / total * 100,)
                for zone, total in d.RESPONDENTS for name in d.SPECIES for way, sign in (("Decrease", -1), ("Increase", 1))}
    result = wb.species(tables)
    check(result, ["zona", "sp_cien", "abundancia"], ["percent"], expected)
    short = {k: v for k, v in expected.items() if k[1] in d.SHORTLIST}
    check(wb.species(tables, shortlist=True), ["zona", "sp_cien", "abundancia"], ["percent"], short)
    assert any(v[0] for k, v in expected.items() if k[1] == "Dactylopterus volitans ")
    outside = sum(1 for v in expected.values() if abs(v[0]) > 60)
    assert censor(result, "percent", *d.SPECIES_LIMITS).count() == len(expected) - outside


@pytest.mark.parametrize("keep_zone", [True, False])
def test_rotation(tables, data, keep_zone):
    ports = defaultdict(list)
    for i, port in data["A_perfil"]:
        ports[i].append(port)
    methods = [*d.GEARS.values(), d.NO_FISHING]
    trips = defaultdict(list)
    for row in data["B_rotacion"]:
        trips[row[0], d.MONTHS.get(row[2])].append(row[3:3 + len(d.GEARS)])
    sums = defaultdict(lambda: [0.0] * len(methods))
    for i in {row[0] for row in data["B_rotacion"]}:
        for month in d.MONTHS.values():
            for port in ports.get(i, [None]):  # the place is looked up for every row of the grid
                found = trips.get((i, month), [])
                # where the zone comes with the trips, a double profile repeats them first
                repeats = [zone_of(p) for p in ports.get(i, [None])] if not keep_zone else [zone_of(port)]
                grid = [(gears, zone) for gears in found for zone in repeats] or [
                    ([None] * len(d.GEARS), zone_of(port) if keep_zone else None)]
                for gears, zone in grid:
                    values = [g or 0.0 for g in gears]
                    for j, value in enumerate([*values, 0.0 if sum(values) else 1.0]):
                        sums[zone, month][j] += value
    expected = {(zone, month, method): (v[j], sum(v), v[j] / sum(v) * 100)
                for (zone, month), v in sums.items() for j, method in enumerate(methods)}
    result = wb.rotation(tables, added_rows_keep_zone=keep_zone)
    check(result, ["zona", "mes", "fishing_method"], ["total_value", "total", "percent"], expected)
    assert (None in {k[0] for k in expected}) is (not keep_zone)
    order = {r.fishing_method: r.ordinal for r in result.collect()}
    assert order["No Pesca"] == 1 and order["Rao"] == len(d.GEAR_LEVELS) and None not in order.values()


def test_donuts(tables, data):
    n = defaultdict(int)
    for row, zone in joined(data, "E_ambiental"):
        answer, kind = row[25], row[26]
        if answer not in (None, "NA"):
            n[zone, answer, kind] += 1
    ring, whole = defaultdict(int), defaultdict(int)
    for (zone, answer, _), count in n.items():
        ring[zone, answer] += count
        whole[zone] += count
    expected = {(z, a, k): (c, ring[z, a] / whole[z] * 100, c / (whole[z] if z in d.DONUTS_OF_WHOLE else ring[z, a]) * 100)
                for (z, a, k), c in n.items()}
    check(wb.donuts(tables), ["zona", "Q19_efecto_now", "Q19_efecto_now_tipo"], ["n", "pie_share", "donut_share"], expected)


def test_clean_tables(tables, data):
    answers = wb.conflict_answers(tables)
    assert answers.columns == ["zona", *ITEMS21]
    found = {r[0] for c in ITEMS21 for r in answers.select(c).distinct().collect()}
    assert found == {*d.CONFLICT_LEVELS, None}
    donuts = wb.donut_answers(tables)
    assert donuts.columns == ["ID", *DONUT, "cofradia", "zona"]
    assert donuts.count() == len(joined(data, "E_ambiental"))


def test_all_results_run(tables):
    results = wb.results(tables)
    assert len(results) == 14
    assert all(frame.limit(1).count() == 1 for frame in results.values())


def test_losses_of_the_results(spark, tables, data, tmp_path):
    losses = Losses()
    results = wb.results(tables, losses)
    for name in ("species_bars", "rotation"):
        results[name].write.parquet(str(tmp_path / name))
    bars = [r.percent for r in wb.species(tables).collect()]
    reports = [(name, way) for _, name, way in data["C_especies"]]
    missing = sum(1 for pair in reports if "NA" in pair or None in pair)
    expected = {
        ("species", "no species or direction", len(reports), missing),
        ("species", "species not listed", len(reports),
         sum(1 for n, w in reports if n not in ("NA", None, *d.SPECIES) and w not in ("NA", None))),
        ("species bars", "below", len(bars), sum(b < -60 for b in bars)),
        ("species bars", "above", len(bars), sum(b > 60 for b in bars)), ("species bars", "missing", len(bars), 0),
        ("rotation", "month not listed", len(data["B_rotacion"]), sum(r[2] not in d.MONTHS for r in data["B_rotacion"]))}
    assert {tuple(r) for r in losses.report(spark).collect()} == expected


def test_items_have_their_place(tables):
    results = wb.results(tables)
    for name, order in (("conflicts", d.CONFLICT_LABELS), ("changes", d.CHANGE_ORDER), ("heatmaps", d.CHANGE_ORDER)):
        assert {r.item: r.position for r in results[name].collect()} == {item: i for i, item in enumerate(order, start=1)}


def test_dropped_and_contradictory_species(spark):
    """By plain loops: a zone's reports both ways, and reports outside the list."""
    profile = [(1, "x"), (2, None), (3, "x")]
    reports = [(1, "Boops boops", "menor"), (3, "Boops boops", "mayor"), (2, "Boops boops", "menor"), (1, "NA", "menor"),
               (3, "NA", "mayor"), (2, None, "mayor"), (9, "no such", "igual"), (2, "no such", "menor")]
    tables = {"A_perfil": spark.createDataFrame(profile, "ID int, cofradia string"),
              "C_especies": spark.createDataFrame(reports, "ID int, sp_cien string, abundancia string")}
    assert [tuple(r) for r in wb.contradictions(tables).collect()] == [("otro", "Boops boops", 2, 1)]
    assert {tuple(r) for r in wb.unlisted_species(tables).collect()} >= {("no such", 2)}
