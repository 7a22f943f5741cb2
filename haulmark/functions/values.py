"""Fixed values of the domain."""

# The categories in their order, with weight and severity.
CATEGORIES = [
    ("Uso de celular", 10, "critico"),
    ("Fatiga en progresion", 8, "critico"),
    ("Ojos cerrados", 6, "critico"),
    ("Riesgo de colision", 5, "alto"),
    ("Bostezo", 3, "alto"),
    ("Camara cubierta", 3, "medio"),
    ("Fumando", 2, "medio"),
    ("Distraccion", 1, "medio"),
]

# Alarm texts and the category that each means.
TEXT_CATEGORIES = {
    "eye closed": "Ojos cerrados",
    "eyes closed": "Ojos cerrados",
    "yawning": "Bostezo",
    "yawn": "Bostezo",
    "fcw (forward collision warning)": "Riesgo de colision",
    "forward collision warning": "Riesgo de colision",
    "phone call alarm": "Uso de celular",
    "using phone while driving": "Uso de celular",
    "distracted driving": "Distraccion",
    "distraction alarm": "Distraccion",
    "distractions alarm": "Distraccion",
    "dms camera covered": "Camara cubierta",
    "camera covered": "Camara cubierta",
    "camera undetected": "Camara cubierta",
    "occlusion": "Camara cubierta",
    "ir-blocking sunglasses": "Camara cubierta",
    "smoking": "Fumando",
    "driver smoking": "Fumando",
    "fatigue driving alarm": "Fatiga en progresion",
}

# Subtype codes, by company default and live.
DEFAULT_SUBTYPES = {"65": "Ojos cerrados", "66": "Bostezo", "67": "Distraccion", "68": "Uso de celular"}
LIVE_SUBTYPES = {"17": "Riesgo de colision", "34": "Uso de celular", "35": "Fumando", "65": "Ojos cerrados", "66": "Bostezo", "68": "Distraccion"}

# Event codes.
EVENT_CODES = {"110": "Riesgo de colision", "116": "Uso de celular", "117": "Fumando", "121": "Ojos cerrados", "122": "Bostezo", "124": "Distraccion"}

# Stems that tell a driver-monitoring alarm by its text.
DMS_STEMS = ["eye", "yawn", "phone", "smok", "distract", "fatigue", "collision", "camera", "sunglass", "dms"]

# The rules' defaults.
RULES = {
    "streak_minutes": 15, "collision_minutes": 30, "yawn_minutes": 60, "eyes_closed_critical": 3, "fatigue_merge_minutes": 60,
    "daily_cap": 20, "distraction_deviation": 3.0, "night_start": 22, "night_end": 5, "late_minutes": 20, "stopped_minutes": 45, "spike": 1.5, "collision_pattern": 3, "yawn_fatigue": 5, "fatigue_profile": 40, "night_profile": 15,
    "future_minutes": 5, "cut_minutes": 15, "overlap_minutes": 30, "match_seconds": 120,
}

# Sources whose events count, and results of ingesting that leave nothing to look at.
ACTIVE_SOURCES = ("harvest", "live", "backfill", "catchup", "admin_backfill")
DONE_RESULTS = ("inserted_alarm_event", "updated_alarm_event")

# The client's confidence in each category.
CONFIDENCE = {
    "Uso de celular": "1.0",
    "Fatiga en progresion": "0.9",
    "Ojos cerrados": "0.5",
    "Riesgo de colision": "0.8",
    "Bostezo": "0.8",
    "Camara cubierta": "0.9",
    "Fumando": "0.7",
    "Distraccion": "0.4",
}

# Phrases of reasons and their labels, in order of replacing.
REASON_LABELS = [
    ("classified non dms", "clasificada como no DMS"),
    ("non dms text", "clasificada como no DMS por texto"),
    ("dms like unmapped", "parece DMS pero quedo sin mapa"),
    ("missing local", "no existe en local"),
    ("stored local unmapped", "guardada local sin mapa"),
    ("stored local classified non dms", "guardada local como no DMS"),
    ("suppressed by rule", "suprimida por regla"),
    ("rejected temporal", "rechazada por temporalidad"),
    ("fused in episode", "fusionada en episodio"),
    ("visible episode", "abre episodio"),
    ("single eye closed", "ojo cerrado aislado"),
    ("distraction below 3x", "distraccion bajo umbral 3x"),
    ("merged yawn into fatigue", "bostezo fusionado a fatiga"),
    ("normalization failed", "fallo de normalizacion"),
    ("missing day km", "sin kilometraje diario confiable"),
    ("day gt total", "km del dia mayor que el total"),
    ("total regression", "regresion de odometro"),
]
