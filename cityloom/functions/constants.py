"""Word lists, rates, literal dimensions. They must stay exactly as given."""

from __future__ import annotations

import unicodedata

# English month names, January first.
MONTHS_EN = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Spanish month names, January first.
MONTHS_ES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)

# Whole-name corrections for cities, applied to cleaned names.
CITY_ALIASES = {
    "sanandresdetumaco": "tumaco",
    "bogotadc": "bogota",
    "puertoinirida": "inirida",
    "buga": "guadalajaradebuga",
}

# Whole-name corrections for departments, applied to cleaned names.
DEPARTMENT_ALIASES = {
    "santafedebogota": "bogotadc",
    "sanandres": "archipielagodesanandresprovidenciaysantacatalina",
}

# Cities kept whatever the two city lists say.
ALWAYS_KEPT_CITIES = ("bogota", "tumaco")

# Yearly price change in percent used to move spend back one year.
DEFLATION_PCT = {
    "average": 3.80, "lodging": 3.46, "transport": 3.41, "food": 5.80, "other": 3.80,
}

# Monthly inflation lists that drive the GDP pattern of each year.
GDP_TRENDS = {
    2018: (3.68, 3.37, 3.14, 3.13, 3.16, 3.20, 3.12, 3.10, 3.23, 3.33, 3.27, 3.18),
    2019: (3.15, 3.01, 3.21, 3.25, 3.31, 3.43, 3.79, 3.75, 3.82, 3.86, 3.84, 3.80),
    2021: (1.6, 1.56, 1.51, 1.95, 3.3, 3.63, 3.97, 4.44, 4.51, 4.58, 5.26, 5.62),
    2022: (6.94, 8.01, 8.53, 9.23, 9.07, 9.67, 10.21, 10.84, 11.44, 12.22, 12.53, 13.12),
    2023: (13.25, 13.28, 13.34, 12.82, 12.36, 12.13, 11.78, 11.43, 10.09, 10.48, 10.15, 9.28),
}

# Monthly lodging trend of each year; 2018 is flat, 2023 is already monthly.
LODGING_TRENDS = {
    2018: (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1),
    2019: (30, 33, 36, 35, 36, 38, 39, 40, 41, 42, 43, 43),
    2021: (42, 43, 47, 40, 41, 42, 43, 45, 46, 47, 50, 54),
    2022: (56, 58, 62, 57, 59, 62, 65, 72, 75, 77, 80, 82),
}

# Twelve draws of N(0, 0.005) under seed 42.
PATTERN_NOISE = (
    0.002483571, -0.000691322, 0.003238443, 0.007615149, -0.001170767, -0.001170685,
    0.007896064, 0.003837174, -0.002347372, 0.0027128, -0.002317088, -0.002328649,
)

# Name, latitude, longitude, reviews, rating of the most visited places.
ATTRACTIONS = (
    ("Ciudad Amurallada", 10.423768016601226, -75.5502221481417, 25118, 4.8),
    ("Monserrate", 4.606442657411985, -74.05488182882448, 26095, 4.7),
    ("Museo Oro", 4.601863737486862, -74.07206921955388, 58443, 4.8),
    ("Museo Pablo Escobar", 6.210940942225721, -75.55666610034157, 6501, 3.8),
    ("Castillo San Felipe", 10.422674818711775, -75.53911007123797, 74950, 4.7),
    ("La Candelaria", 4.596356204217971, -74.07036887708271, 39991, 4.6),
    ("Museo Botero", 4.596783977356232, -74.07317983196756, 31991, 4.8),
    ("Piedra Penol", 6.224293398570674, -75.17846180492857, 6259, 4.7),
    ("Parque Tayrona", 11.30661973931487, -74.06558444232788, 30531, 4.7),
    ("Ciudad Perdida", 10.69977509707966, -74.21719016507225, 12422, 4.5),
    ("Johnny Cay", 12.599844555163797, -81.68958552452854, 8137, 4.6),
    ("Mina sal", 5.064130673191533, -73.87412723129202, 15627, 4.8),
    ("Parque Explora", 6.271873980048277, -75.56529352888349, 10158, 4.8),
    ("Parque del cafe", 4.540472412992844, -75.7704120656708, 67073, 4.8),
    ("Getsemani", 10.420236347859726, -75.5457920284369, 10717, 4.7),
    ("Laguna Guatavita", 4.978042131016031, -73.77411934630805, 2401, 4.6),
    ("Laguna Guatape", 6.2625426509484585, -75.18889681059652, 3587, 4.9),
    ("Zoo Cali", 3.4483110753559307, -76.5567835595829, 32880, 4.7),
    ("Jaime Duque", 4.950933448804722, -73.96450197491808, 6166, 4.8),
    ("Museo Antioquia", 6.252582668979805, -75.56902381539014, 10409, 4.7),
    ("Bosque Palmas", 4.642619785055463, -75.48545072059876, 8025, 4.8),
    ("santuario san pedro claver", 10.421942528179812, -75.55101547480216, 5212, 4.7),
    ("Santuario Las Lajas", 0.8056145166329276, -77.58580465582233, 11636, 4.8),
    ("Medellin MetroCable", 6.293713286896887, -75.54049102937564, 9273, 4.7),
    ("Villa de leyva", 5.636740186520528, -73.52642769258925, 13454, 4.8),
    ("Salento", 4.637632624472757, -75.57107751600738, 2326, 4.7),
    ("Islas Rosario", 10.198113718483176, -75.75728109040843, 1528, 4.5),
    ("Cano cristales", 2.2654672947309984, -73.7904893534562, 745, 4.9),
    ("Cabo de la vela", 12.19584280316732, -72.14670358044717, 503, 4.7),
    ("Parque Nacional Natural El Cocuy", 6.366594015120004, -72.32930605910018, 1468, 4.8),
    ("Jardin", 5.599970208507919, -75.82197889439527, 1923, 4.7),
    ("Canon guejar", 3.34558725490291, -74.00251320801074, 223, 5.0),
    ("Chingaza", 4.736759401563025, -73.84183421964912, 844, 4.9),
    ("Selva Amazonas", -1.9373373758415269, -70.09301207031643, 88, 4.5),
    ("Rio miel", 5.77684008762934, -74.68539501381262, 75, 4.2),
    ("Cerros de Mavecure", 3.8685506255477473, -67.90980077915421, 169, 4.7),
    ("Desiero Tatacoa", 3.233661252748834, -75.167678435162, 3649, 4.8),
    ("Parque Uramba", 4.009359201162415, -77.24025001985369, 2085, 4.7),
    ("Naqui", 5.711911987713407, -77.26317845045835, 1239, 4.6),
    ("San Jose Guaviare", 2.5680632175041964, -72.6400738137754, 4312, 4.8),
    ("Cascada Fin del Mundo", 1.1049043406387264, -76.61366052942371, 138, 4.8),
)


def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: Latin-1 and Latin Extended-A letters to their base
    letter, then the combining marks, which have no counterpart and so are deleted."""
    src, dst = [], []
    for code in range(0xC0, 0x180):
        kept = [c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(kept) == 1 and kept[0] != chr(code):
            src.append(chr(code))
            dst.append(kept[0])
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn"]
    return "".join(src + marks), "".join(dst)
