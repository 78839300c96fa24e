"""Labels, thresholds and colours used across the library.

Two groups live here. The first are fixed values: they must equal what the
dashboard pages compare against or display, so they are stated literally.
The second are our own parameter defaults for formulas the pages leave to a
takes them as arguments.
"""

from __future__ import annotations

# --- fixed values (must equal the dashboard's literals) -----------------------

# Driver / vehicle status labels, as the pages compare them.
VERDE = "verde"
AMARILLO = "amarillo"
NARANJA = "naranja"
ROJO = "rojo"

# Fatigue labels in the three vocabularies, one tuple per level:
# (fatigue table, filter box, dashboard chart).
FATIGUE_LEVELS = (
    ("crítica", "grave", "Fatiga"),
    ("leve", "leve", "Fatiga leve"),
    ("baja", "ninguna", "Apto"),
)
CRITICA, LEVE, BAJA = (level[0] for level in FATIGUE_LEVELS)

# Text shown for a missing date, and for a missing dashboard metric.
SIN_DATOS = "Sin datos"
NO_VALUE = "--"

# Pie-slice colours of the dashboard charts; unknown labels are grey.
SLICE_GREEN = "#22c55e"
SLICE_YELLOW = "#facc15"
SLICE_RED = "#ef4444"
SLICE_GREY = "#a3a3a3"

# Report indicator names, in display order.
IND_INSPECCIONES = "Inspecciones realizadas"
IND_CONDUCTORES_CRITICOS = "Conductores en estado crítico"
IND_VEHICULOS_FALLAS = "Vehículos con fallas"
IND_FATIGA = "Fatiga detectada"

# Plate modes offered by the upload form; flexible is the default.
PLATE_MODES = ("strict", "flexible", "permissive")
DEFAULT_PLATE_MODE = "flexible"

# Search parameter domains enforced by the search form.
MES_RANGE = (1, 12)
ANO_RANGE = (2000, 2100)


# D1: driver status from days since the last inspection (upper bounds, inclusive).
DRIVER_BANDS = ((90, VERDE), (365, AMARILLO))
# D2: vehicle status bands.
VEHICLE_BANDS = ((20, VERDE), (45, AMARILLO), (90, NARANJA))
# D4: fatigue level from score (lower bounds, inclusive).
FATIGUE_CRITICA_MIN = 150.0
FATIGUE_LEVE_MIN = 80.0
# D6: a vehicle is overdue after this many days (or when never inspected).
OVERDUE_DAYS = 90
# D8: the canonical plate shape.
PLATE_PATTERN = r"^[A-Z]{3}[0-9]{3}$"
# D13: inspection result that marks a failure.
RESULTADO_FALLA = "F"
# D14: label of a month bucket.
MONTH_LABEL_FORMAT = "yyyy-MM"
# Display format of dates in the tables (a fixed pattern instead of a browser locale).
DISPLAY_DATE_FORMAT = "dd/MM/yyyy"
