"""Fixed values of the proposal-funnel domain.

Everything in the "fixed values" blocks below must equal the business
vocabulary the results are compared against (labels, keywords, names,
parameters).  They are stated plainly, in natural order, on purpose.
"""

from __future__ import annotations

# --- fixed values: sentinels and currencies --------------------------------
NOT_SPECIFIED = "No especificado"
OTHER_CURRENCY = "Otra"
PEN = "S/."
USD = "US$"
VALID_CURRENCIES = [PEN, USD]
RANDOM_STATE = 42
TEST_SIZE = 0.20

# --- fixed values: proposal states in the source table ---------------------
STATE_ACTIVE = "HP Activo"
STATE_INACTIVE = "HP Inactivo"

# --- fixed values: funnel stages, in display order -------------------------
STAGE_CONVERTED = "Convertida a OI"
STAGE_ACTIVE = "HP activa sin OI"
STAGE_INACTIVE = "HP inactiva sin OI"
STAGE_OTHER = "Otro / no especificado"
FUNNEL_ORDER = [STAGE_CONVERTED, STAGE_ACTIVE, STAGE_INACTIVE, STAGE_OTHER]

# --- fixed values: analytical-proposal conversion status -------------------
HP_NONE = "No convertida"
HP_TOTAL = "Conversión total"
HP_PARTIAL = "Conversión parcial"

# --- fixed values: non-conversion reason rules ------------------------------
# Ordered: the first rule whose keyword test matches the normalised text
# wins.  Each rule is (label, any-of keywords).  The staffing rule needs one
# keyword from each of its two groups.
REASON_NOT_SPECIFIED = "No especificado"
REASON_REFERENCE_COST = "Costo de referencia"
REASON_PRICE = "Precio / presupuesto"
REASON_STANDBY = "Proyecto en stand by"
REASON_NO_ANSWER = "Ausencia de respuesta / vencimiento"
REASON_OTHER_SUPPLIER = "Eligió otro proveedor"
REASON_NO_EQUIPMENT = "No cuenta con equipo"
REASON_STAFF = "Disponibilidad / habilitación de personal"
REASON_OTHER_HP = "Atendido con otra HP/OI"
REASON_NOT_REQUIRED = "Servicio no requerido"
REASON_OTHER = "Otros motivos"

REASON_RULES_BEFORE_STAFF = [
    (REASON_REFERENCE_COST, ["COSTO DE REFERENCIA", "COSTO REFERENCIAL"]),
    (REASON_PRICE, ["PRECIO", "PRESUPUESTO", "COSTO ELEVADO"]),
    (REASON_STANDBY, ["STAND BY", "STANDBY"]),
    (REASON_NO_ANSWER, ["AUSENCIA DE RESPUESTA", "VENCIMIENTO", "SIN RESPUESTA"]),
    (REASON_OTHER_SUPPLIER, ["OTRO PROVEEDOR"]),
    (REASON_NO_EQUIPMENT, ["NO CUENTA CON EQUIPO", "NO CONTABA CON EQUIPO"]),
]
STAFF_GROUP_A = ["DISPONIBILIDAD", "HABILITACION"]
STAFF_GROUP_B = ["INSPECTOR", "INSTRUCTOR"]
REASON_RULES_AFTER_STAFF = [
    (REASON_OTHER_HP, ["OTRA HP", "OTRA OI"]),
    (REASON_NOT_REQUIRED, ["NO REQUIER", "NO TOMAR"]),
]
PRICE_COST_REASONS = [REASON_REFERENCE_COST, REASON_PRICE]

# --- fixed values: feature lists of the models ------------------------------
NUMERIC_FEATURES = ["ImporteB", "nParticipante", "duracion", "ANIO"]
CATEGORICAL_CLASS_FEATURES = [
    "idUnidNeg",
    "DES_AO",
    "Desc_Servicio",
    "NomCliente",
    "LugarEjec",
    "Consultor",
    "MON",
    "Rubro",
]
CATEGORICAL_REG_FEATURES = [
    "idUnidNeg",
    "DES_AO",
    "Desc_Servicio",
    "NomCliente",
    "LugarEjec",
    "Consultor",
    "Rubro",
]

# --- fixed values: business names of the model inputs -----------------------
BUSINESS_NAMES = {
    "ImporteB": "Importe bruto de la HP",
    "nParticipante": "Cantidad de participantes",
    "duracion": "Duración registrada",
    "ANIO": "Año de generación de la HP",
    "idUnidNeg": "Unidad de negocio",
    "DES_AO": "Área o línea de servicio",
    "Desc_Servicio": "Servicio cotizado",
    "NomCliente": "Cliente",
    "LugarEjec": "Lugar de ejecución",
    "Consultor": "Consultor responsable",
    "MON": "Moneda",
    "Rubro": "Rubro",
}

# --- fixed values: client segmentation ---------------------------------------
SEGMENT_HIGH = "Alto valor y alta actividad"
SEGMENT_LOW = "Menor actividad y alta conversión"
SEGMENT_NONE = "Sin segmento validado"
CLIENT_FEATURES = [
    "facturacion_soles_total",
    "facturacion_dolares_total",
    "porcentaje_diferencia_mediana",
    "participantes_total",
    "duracion_promedio",
    "tasa_conversion_hp_oi",
    "cantidad_servicios_distintos",
    "cantidad_registros",
]
LOG_FEATURES = [
    "facturacion_soles_total",
    "facturacion_dolares_total",
    "participantes_total",
    "cantidad_servicios_distintos",
    "cantidad_registros",
]
TOP_CLIENTS_PER_SEGMENT = 25
KMEANS_MAX_K = 10
KMEANS_RESTARTS = 10

# --- fixed values: scoring bands (inclusive lower bounds) -------------------
BAND_HIGH = (0.75, "Potencial alto")
BAND_MID_HIGH = (0.50, "Potencial medio-alto")
BAND_MID = (0.30, "Potencial intermedio")
BAND_LOW = "Potencial bajo"
BAND_MESSAGES = {
    "Potencial alto": "El escenario aparece en el grupo de mayor potencial relativo. Conviene priorizar "
                      "el seguimiento, validando disponibilidad, precio y condiciones comerciales.",
    "Potencial medio-alto": "El escenario supera el punto de decisión, pero requiere revisión comercial antes de "
                            "asignar prioridad alta.",
    "Potencial intermedio": "El potencial estimado es intermedio. Puede mejorar con una propuesta mejor calificada "
                            "o mayor información sobre el cliente y el servicio.",
    "Potencial bajo": "El escenario se parece más a operaciones de facturación baja o media dentro de su moneda. "
                      "No significa que deba descartarse; indica menor prioridad relativa según el historial.",
}
DETAIL_VARIABLES = [
    "Cliente",
    "Servicio",
    "Área",
    "Importe simulado",
    "Participantes simulados",
    "Duración simulada",
    "Probabilidad de alta relativa",
    "Facturación histórica del caso",
]
NO_BILLING = "Sin facturación registrada"
DECISION_THRESHOLD = 0.50
DEFAULT_DURATION = 15.0
SHORTEN_LENGTH = 52
ELLIPSIS = "…"

# --- fixed values: infrequent-category thresholds ---------------------------
MIN_FREQUENCY_CLASS = 10
MIN_FREQUENCY_REG = {PEN: 10, USD: 5}
RECENT_CASES = 2500
# test quality that the classifier's ROC-AUC and each regressor's R2 must exceed
AUC_FLOOR, R2_FLOOR = 0.95, 0.70
# changes in percent (amount, participants, duration) of the registered scenario queries
SCENARIO_POINTS = [(0, 0, 0), (10, 20, 0), (-20, 0, 50), (50, 100, -50)]
AGED_DAYS = 90

# --- fixed values: source columns of the proposal-line table ---------------
CATEGORICAL_SOURCE_COLUMNS = [
    "idUnidNeg",
    "DES_AO",
    "Desc_Servicio",
    "NomCliente",
    "LugarEjec",
    "Consultor",
    "MON",
    "Rubro",
    "Desc_Estado",
    "DescAnulado",
]
DASHBOARD_COLUMNS = [
    "Fecha",
    "FechaOI",
    "ANIO",
    "numHP",
    "idUnidNeg",
    "DES_AO",
    "Desc_Servicio",
    "NomCliente",
    "duracion",
    "LugarEjec",
    "nParticipante",
    "Consultor",
    "MON",
    "ImporteB",
    "impFacturado",
    "Rubro",
    "Desc_Estado",
    "DescAnulado",
    "propuesta_convertida",
    "dias_conversion_hp_oi",
    "diferencia_facturacion",
    "ingreso_neto_estimado",
    "etapa_comercial",
    "motivo_negocio",
]
