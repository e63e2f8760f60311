"""Declared schemas of the raw inputs (names as they arrive, types as they are read)."""

# Column names of the raw tables.
VISITORS = "`Año` int, Ciudad string, Mes int, `Extranjeros no Residentes` bigint"
CRIME_HEADER = ["FECHA HECHO", "MUNICIPIO", "CANTIDAD"]
CITIES = "city string, lat double, lng double, admin_name string, population bigint"
WEATHER = "FechaObservacion string, Municipio string, ValorObservado double"
FX = "Fecha string, Dolar double"
GDP = "`CÓDIGO` string, DEPARTAMENTO string, `VALOR (unidades)` string"
MUNICIPAL_WEIGHT = (
    "Departamento string, `Municipio / Distrito` string, "
    "`Peso relativo municipal en el valor agregado departamental %` double"
)
BORDER_ENTRIES = "`Año` int, Mes string, `Latitud - Longitud` string, Total bigint"
LODGING = "`AÑO` int, `NOMBRE-MUNI` string, NOMDEP string, CATEGORIA string, HABITACIONES bigint, CAMAS bigint"
LODGING_2023 = (
    "MUNICIPIO string, MES int, CATEGORIA string, `NÚMERO DE HABIATACIONES` bigint, `NÚMERO DE CAMAS` bigint"
)
INFLATION = "Fecha string, Inflacion double"
EVENTS = "Departamento string, Mes int, Eventos bigint"
LAND_AREAS = "ciudad string, `año` int, urban double, green double, water double"
PIXELS = (
    "city string, year int, scene_id string, scene_ts timestamp, scene_cloud_pct double, px int, py int, "
    "b2 int, b3 int, b4 int, b8 int, b11 int, b12 int, cloud_prob int"
)

# Spend columns in the order average, lodging, transport, food, other.
SPEND_DAILY = ["Gasto Promedio Diario", "Gasto Alojamiento Diario", "Gasto Transporte Diario",
               "Gasto alimetos Diario", "Otros Gastos Diario"]
SPEND_TRIP = ["Gasto Promedio Viaje", "Gasto  Alojamiento Viaje", "Gasto Transporte Viaje",
              "Gasto alimetos Viaje", "Otros Gastos Viaje"]

# Exported name of every panel column.
PANEL_EXPORT_NAMES = {
    "city": "Ciudad", "period": "Mes", "visitors": "Nmero Extranjeros", "homicides": "Homicidios",
    "thefts": "Hurtos", "sexual_crimes": "Delitos Sexuales", "department": "Departamento",
    "temperature": "Temperatura", "fx": "Dolar", "weighted_gdp": "Pib Ponderado",
    "zone_entries": "Entradas Extranjeros Zona", "access_distance": "Distancia a accseos",
    "access_importance": "importancia accesos", "establishments": "Establecimientos de turismo",
    "rooms": "N Habitaciones", "beds": "N Camas", "top_distance": "Distancia al TOP",
    "poverty_proxy": "Proxy Pobreza", "daily_average": "Gasto Promedio Diario",
    "daily_lodging": "Gasto Alojamiento Diario", "daily_transport": "Gasto Transporte Diario",
    "daily_food": "Gasto alimetos Diario", "daily_other": "Otros Gastos Diario",
    "trip_average": "Gasto Promedio Viaje", "trip_lodging": "Gasto  Alojamiento Viaje",
    "trip_transport": "Gasto Transporte Viaje", "trip_food": "Gasto alimetos Viaje",
    "trip_other": "Otros Gastos Viaje", "inflation": "Inflacion", "roads": "Nmero Vias",
    "events": "Eventos", "urban_area": "Area Urbana", "rural_area": "Area Rural",
    "water_area": "Area Agua",
}
