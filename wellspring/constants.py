"""Names, bounds, rules and texts that results depend on."""

# --- fixed values: sensors, in feature order --------------------------------
PRIMARY_SENSORS = [
    "P-PDG", "P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP", "P-ANULAR", "T-PDG",
    "P-JUS-CKGL", "QGL", "ABER-CKP", "ABER-CKGL", "T-MON-CKP", "P-JUS-CKP",
]
STATISTICS = ["mean", "std", "min", "max", "median", "range", "trend"]
META_COLUMNS = [
    "raw_class", "multiclass", "binary_target", "is_transient",
    "instance_file", "well_id", "event_folder",
]

# --- fixed values: physically possible range by name prefix -----------------
PHYSICAL_RANGES = [
    (("P-", "PT-"), -1e4, 2e8),
    (("T-",), -50.0, 400.0),
    (("ABER-",), 0.0, 100.0),
    (("Q",), 0.0, 1e4),
]
OTHER_RANGE = (-1e6, 1e10)
FEATURE_CLIP = (-1e9, 1e9)

# --- fixed values: event names ------------------------------------------------
EVENT_NAMES = {
    0: "Normal Operation",
    1: "Abrupt Increase of BSW",
    2: "Spurious Closure of DHSV",
    3: "Severe Slugging",
    4: "Flow Instability",
    5: "Rapid Productivity Loss",
    6: "Quick Restriction in PCK",
    7: "Scaling in PCK",
    8: "Hydrate in Production Line",
    9: "Hydrate in Service Line",
}
TRANSIENT_EVENTS = [1, 2, 5, 6, 7, 8, 9]
NORMAL_EVENT = EVENT_NAMES[0]

# --- fixed values: nominal operating bounds (raw units) -----------------------
NOMINAL_BOUNDS = [
    ("P-PDG", 200e5, 350e5, "200 - 350 bar (Downhole Pressure)"),
    ("P-TPT", 100e5, 200e5, "100 - 200 bar (Transducer Pressure)"),
    ("T-TPT", 50.0, 95.0, "50 - 95 °C (Transducer Temperature)"),
    ("P-MON-CKP", 80e5, 180e5, "80 - 180 bar (Upstream Choke Pressure)"),
    ("T-JUS-CKP", 30.0, 80.0, "30 - 80 °C (Downstream Choke Temperature)"),
    ("P-ANULAR", 0.0, 40e5, "0 - 40 bar (Annulus 'A' Pressure)"),
    ("T-PDG", 60.0, 120.0, "60 - 120 °C (Downhole Gauge Temperature)"),
    ("QGL", 0.0, 50.0, "Nominal Gas Lift Injection Rate"),
    ("ABER-CKP", 10.0, 100.0, "10 - 100% Choke Opening"),
]

# --- fixed values: display envelopes: sensor, unit, region, factor, min, max --
DISPLAY_ENVELOPES = [
    ("P-PDG", "bar", "Downhole / Reservoir", 1e-5, 150.0, 400.0),
    ("P-TPT", "bar", "Subsea Wellhead", 1e-5, 50.0, 250.0),
    ("T-TPT", "°C", "Subsea Wellhead", 1.0, 20.0, 100.0),
    ("P-MON-CKP", "bar", "Production Choke (Upstream)", 1e-5, 30.0, 200.0),
    ("T-JUS-CKP", "°C", "Production Choke (Downstream)", 1.0, 10.0, 80.0),
    ("P-JUS-CKGL", "bar", "Gas Lift Injection", 1e-5, 50.0, 220.0),
    ("T-JUS-CKGL", "°C", "Gas Lift Injection", 1.0, 10.0, 70.0),
    ("QGL", "m³/s", "Gas Lift Injection", 1.0, 0.0, 50.0),
]
DISPLAY_SENSORS = [
    "P-PDG", "P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP",
    "P-JUS-CKGL", "T-JUS-CKGL", "QGL", "P-ANULAR", "ABER-CKP",
]
FEED_COLUMNS = [
    "id", "device_id", "timestamp", "status", "fault", "P-PDG", "P-TPT", "T-TPT",
    "P-MON-CKP", "T-JUS-CKP", "P-JUS-CKGL", "QGL", "P-ANULAR",
]
FLEET_COLUMNS = ["id", "device_id", "timestamp", "status", "fault", "P-TPT", "T-TPT", "P-MON-CKP"]
AVERAGED_SENSORS = ["P-PDG", "P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP"]
CORRELATED_SENSORS = ["P-PDG", "P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP", "P-ANULAR", "QGL"]

# --- fixed values: threshold rules: device type, field, op, threshold, default, fault
FAULT_RULES = [
    ("CNC", "spindle_temperature", ">", 85.0, 0.0, "spindle_overheating"),
    ("CNC", "vibration", ">", 8.0, 0.0, "excessive_vibration"),
    ("CNC", "tool_wear", ">", 80.0, 0.0, "tool_wear"),
    ("PRESS", "hydraulic_pressure", "<", 80.0, 0.0, "hydraulic_pressure_drop"),
    ("PRESS", "oil_temperature", ">", 85.0, 0.0, "oil_overheating"),
    ("PRESS", "vibration", ">", 8.0, 0.0, "excessive_vibration"),
    ("CONVEYOR", "motor_temperature", ">", 85.0, 0.0, "motor_overheating"),
    ("CONVEYOR", "belt_alignment", ">", 5.0, 0.0, "belt_misalignment"),
    ("CONVEYOR", "vibration", ">", 8.0, 0.0, "excessive_vibration"),
    ("ROBOT", "motor_temperature", ">", 85.0, 0.0, "motor_overheating"),
    ("ROBOT", "joint_vibration", ">", 8.0, 0.0, "joint_vibration"),
    ("ROBOT", "load", ">", 90.0, 0.0, "excessive_load"),
    ("PUMP", "cavitation", ">", 0.8, 0.0, "cavitation"),
    ("PUMP", "pressure", "<", 40.0, 0.0, "pressure_drop"),
    ("PUMP", "motor_temperature", ">", 85.0, 0.0, "motor_overheating"),
    ("COMPRESSOR", "discharge_pressure", ">", 150.0, 0.0, "high_discharge_pressure"),
    ("COMPRESSOR", "motor_temperature", ">", 85.0, 0.0, "motor_overheating"),
    ("COMPRESSOR", "vibration", ">", 8.0, 0.0, "excessive_vibration"),
    ("ENERGY_METER", "voltage_imbalance", ">", 5.0, 0.0, "voltage_imbalance"),
    ("ENERGY_METER", "power_factor", "<", 0.7, 1.0, "low_power_factor"),
    ("ENERGY_METER", "thd", ">", 8.0, 0.0, "high_thd"),
]
RULE_DEVICE_TYPES = ["CNC", "PRESS", "CONVEYOR", "ROBOT", "PUMP", "COMPRESSOR", "ENERGY_METER"]

# --- fixed values: messages and throttling ------------------------------------
TOPIC_PATTERN = "^factory/[^/]+/[^/]+/telemetry$"
UNKNOWN_DEVICE = "LIVE-DEVICE"
COOLDOWN_SECONDS = 30

# --- fixed values: confidence bands ---------------------------------------------
HIGH_CONFIDENCE = 0.8
MODERATE_CONFIDENCE = 0.65

# --- fixed values: retrieval ------------------------------------------------------
BOOST_FACTOR = 1.5
BOOST_OFFSET = 0.3
QUERY_PHRASE = "symptoms causes diagnostic checks recommended operator actions safety considerations"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- fixed values: short English stop-word list (Spark's default list without
# the contractions, which the token pattern never produces) ------------------------
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very can will just don should now cannot could "
    "ought would"
).split()
