"""Fixed values of the small-scale fishery survey the six analyses were made for.

The library itself takes all of these as arguments.
"""

from __future__ import annotations

# Ports of each zone; any other port, or none, is "otro".
ZONES = {
    "Mallorca North": ["Andratx", "Soller", "Pollença"],
    "Mallorca South-West": ["Palma", "Colonia de Sant Jordi", "Santanyi", "Portocolom"],
    "Mallorca South-East": ["Alcudia", "Cala Ratjada", "Porto Cristo"],
    "Pitiusas": ["San Antoni de Portmany", "Eivissa", "Formentera"],
    "Menorca": ["Ciutadella", "Fornells", "Mao"],
}

# Answers and levels of the conflict block. "NS/NC" is not a level here.
CONFLICT_ANSWERS = {
    "muy negativo": "Very Negative",
    "negativo": "Negative",
    "neutro": "Neutral",
    "positivo": "Positive",
    "muy positivo": "Very Positive",
}
CONFLICT_LEVELS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
CONFLICT_RANGE = ("Q21a_profesional", "Q21m_turismo")
CONFLICT_LABELS = [
    "Industrial Fisheries", "Recreational Spearfishing", "Recreational Boat Fishing",
    "Recreational Shore Fishing", "Recreational Boats", "Jet Skis", "Scuba Diving",
    "Other Recreational Activities", "Maritime Transport", "Sewage Outfalls",
    "Coastal Development", "Beach Users", "Tourism",
]
# Positions of each theme's items, counted with the zone as column 1.
CONFLICT_THEMES = {
    "other fisheries": [range(2, 6)],
    "non-extractive recreation": [range(6, 10), range(13, 15)],
    "development": [range(10, 13)],
}

# Answers and levels of the environment block.
CHANGE_ANSWERS = {
    "disminuido": "Decrease",
    "NS/NC": "Don't Know",
    "igual": "No Change",
    "cambio": "Change",
    "aumentado": "Increase",
}
CHANGE_LEVELS = ["Decrease", "Don't Know", "No Change", "Change", "Increase"]
CHANGE_RANGE = ("Q19a_oaire", "Q19k_estaciones")
CHANGE_LABELS = [
    "Air Heat-Waves", "Marine Heat-Waves", "Storm Freq.", "Storms Intensity", "Precipitation",
    "Sea Temperature", "Current Intensity", "Current Direction", "Wind Intensity",
    "Wind Direction", "Seasonality",
]
CHANGE_ORDER = [
    "Air Heat-Waves", "Marine Heat-Waves", "Sea Temperature", "Precipitation", "Storm Freq.",
    "Storms Intensity", "Wind Intensity", "Wind Direction", "Current Intensity",
    "Current Direction", "Seasonality",
]

# Abundance answers, respondents per zone, species list and shortlist.
ABUNDANCE = {"menor": "Decrease", "igual": "No Change", "mayor": "Increase"}
RESPONDENTS = [
    ("Pitiusas", 17), ("Menorca", 16), ("Mallorca North", 11), ("Mallorca South-West", 17),
    ("Mallorca South-East", 14),
]
SPECIES = [
    "Spicara smaris", "Mullus surmuletus", "Trachurus ssp.", "Octopus vulgaris", "Dentex dentex",
    "Dasyatis pastinaca", "Scyliorhinus canicula", "Epinephelus marginatus", "Scorpaena scrofa",
    "Pagrus pagrus", "Palinurus elephas", "Rostroraja alba", "Gymnura altavela", "Cnidaria spp.",
    "Sepia officinalis", "Coryphaena hippurus", "Zeus faber", "Aristeus antennatus",
    "Nephrops norvegicus", "Scorpaena porcus", "Raja spp.", "Lophius spp.", "Labrus spp.",
    "Pagellus bogaraveo", "Chlorophyta sp.", "Balistes capriscus", "Loligo vulgaris",
    "Ostrea edulis", "Arca noae", "Lithophaga lithophaga", "Aphia minuta", "Pinna nobilis",
    "Bivalvia spp.", "Mollusca spp.", "Diplodus sargus", "Sparus aurata", "Maja squinado",
    "Melicertus kerathurus", "Uranoscopus scaber", "Sciaena umbra", "Amphipods & Isopods",
    "Thunnus thynnus", "Seriola dumerili", "Scyllarides latus", "Tursiops truncatus",
    "Scomber scombrus", "Raja clavata", "Sphyraena spp.", "Salpidae spp.", "Serranus scriba",
    "Sarda sarda", "Engraulis encrasicolus", "Epinephelus costae", "Trachinus ssp.", "Bothus podas",
    "Xyrichtys novacula", "Phycis spp.", "Belone belone", "Squatina squatina", "Argyrosomus regius",
    "Auxis rochei", "Euthynnus alletteratus", "Thunnus alalunga", "Scyliorhinus stellaris",
    "Mustelus mustelus", "Spondyliosoma cantharus", "Laminaria rodriguezii", "Spicara maena",
    "Pelagia noctiluca", "Muraena helena", "Dactylopterus volitans ", "Naucrates ductor",
    "Polyprion americanus", "Chelonioidea spp.", "Chelidonichthys lucerna", "Brachyura spp.",
    "Ensis magnus", "Donax trunculus",
]
SHORTLIST = [
    "Coryphaena hippurus", "Scorpaena scrofa", "Sepia officinalis", "Palinurus elephas",
    "Seriola dumerili", "Dentex dentex", "Scorpaena porcus", "Pagrus pagrus", "Octopus vulgaris",
    "Aphia minuta", "Spicara maena", "Thunnus thynnus", "Spondyliosoma cantharus",
    "Epinephelus marginatus", "Lophius spp.", "Euthynnus alletteratus", "Zeus faber",
]
SPECIES_LIMITS = (-60, 60)

# Smallest and largest mark of a port on the map.
MARK_SIZES = (3.0, 10.0)

# Months, and gear columns with their labels.
MONTHS = {
    "enero": "Enero", "febrero": "Febrero", "marzo": "Marzo", "abril": "Abril", "mayo": "Mayo",
    "junio": "Junio", "julio": "Julio", "agosto": "Agosto", "septiembre": "Septiembre",
    "octubre": "Octubre", "noviembre": "Noviembre", "diciembre": "Diciembre",
}
NO_FISHING = "No Pesca"
GEARS = {
    "toninaina": "Tonaira", "moruna": "Moruna", "solta": "Solta", "bonitonera": "Bonitonera",
    "gerretera": "Gerretera", "jonquillera": "Jonquillera", "llampuguera": "Llampuguera",
    "nansas": "Nasas", "tamb_moren": "Tambor Morenas", "trasm_lang": "Trasm Langosta",
    "trasm_lblanca": "Trasm Langosta B", "trasm_peix": "Trasm Pescado",
    "trasm_moll": "Trasm Salmonete", "trasm_sepia": "Trasm Sepia", "bolero": "Bolero",
    "beta": "Beta", "bolitx": "Bolitx", "currican": "Currican", "linea_mano": "Linea Mano",
    "potera": "Potera", "palangre": "Palangre Fondo", "rao": "Rao",
    "sard_agull": "Sardinal Agullas",
}
# "Caña" is a level without data.
GEAR_LEVELS = [
    "No Pesca", "Tonaira", "Moruna", "Solta", "Bonitonera", "Gerretera", "Jonquillera",
    "Llampuguera", "Sardinal Agullas", "Nasas", "Tambor Morenas", "Trasm Langosta",
    "Trasm Langosta B", "Trasm Pescado", "Trasm Salmonete", "Trasm Sepia", "Bolero", "Beta",
    "Bolitx", "Currican", "Linea Mano", "Caña", "Potera", "Palangre Fondo", "Rao",
]

# Zones whose outer ring shows shares of the whole zone.
DONUTS_OF_WHOLE = ["Mallorca South-West", "Pitiusas"]
