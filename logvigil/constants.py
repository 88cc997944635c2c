"""Names, thresholds and term lists the results depend on."""

# --- fixed values: canonical log columns and the header names they accept ---
COLUMN_ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date"),
    "src_ip": ("src_ip", "source_ip", "src", "from_ip"),
    "dst_ip": ("dst_ip", "dest_ip", "destination", "dst"),
    "event_type": ("event_type", "type", "action", "alert", "event"),
    "severity": ("severity", "priority", "level", "risk"),
    "user_account": ("user", "username", "account", "user_id"),
    "device_id": ("device", "host", "hostname", "machine", "endpoint"),
    "protocol": ("protocol", "proto"),
    "dst_port": ("port", "dst_port", "destination_port", "dport"),
    "bytes_transferred": ("bytes", "data_size", "payload", "size"),
}
REQUIRED_LOG_COLUMNS = ("timestamp", "src_ip", "dst_ip", "event_type")

# --- fixed values: anomaly rules ---
FAILED_TERMS = ("fail", "denied", "invalid")
HOME_PREFIXES = ("196.", "197.", "105.", "41.")
SPIKE_MIN_EVENTS = 3
SPIKE_FACTOR = 3
RAPID_EVENTS, RAPID_SECONDS = 3, 60
BRUTE_EVENTS, BRUTE_SECONDS = 5, 600
SCAN_PORTS = 10

# --- fixed values: points and label of each anomaly reason, in rule order ---
REASON_POINTS = {
    "AMOUNT_SPIKE": (25, "Unusual data volume"),
    "RAPID_SUCCESSION": (30, "High-frequency event pattern"),
    "OFF_HOURS": (10, "Off-hours activity"),
    "ROUND_BYTES": (15, "Structured data transfer"),
    "NEW_SOURCE": (20, "Unknown source"),
    "PORT_SCAN": (25, "Port scanning detected"),
    "CROSS_BORDER": (20, "Cross-border network activity"),
    "BRUTE_FORCE": (30, "Brute force authentication attempt"),
}
PROTOCOL_SIGNAL = (20, "Protocol anomaly")
OUTLIER_SIGNAL = (15, "Statistical outlier (ML)")
SERVICE_SIGNAL = (20, "High-risk service category")
TRANSFER_SIGNAL = (25, "Large data transfer (exfiltration risk)")
LARGE_TRANSFER_BYTES = 50_000_000.0
PORT_PROTOCOLS = {
    80: ("HTTP",),
    443: ("HTTPS", "TLS", "SSL"),
    22: ("SSH",),
    25: ("SMTP",),
    53: ("DNS",),
}
SERVICE_TERMS = ("crypto", "tor", "proxy", "casino", "darknet")
LEVELS = ("None", "Low", "Medium", "High", "Critical")

# --- fixed values: term lists of the regulatory and regional flags ---
PERSONAL_TERMS = (
    "login", "authentication", "user", "account", "email", "identity",
    "credential", "profile", "personal", "record", "customer",
)
SERVICE_ACCOUNT_TERMS = ("svc_", "sys_", "admin", "service", "operator", "batch", "daemon")
BANKING_TERMS = ("bank", "payment", "transfer", "swift", "transaction")
UTILITY_TERMS = ("eskom", "loadshedding", "load_shedding", "prepaid", "meter", "outage")
GOVERNMENT_TERMS = (".gov.za", "gov_portal", "government")
MOBILE_MONEY_TERMS = ("ussd", "ewallet", "momo", "mobile_money")
RANSOMWARE_TERMS = ("ransomware", "encrypt")
MUNICIPAL_TERMS = ("municipality", "municipal")
ONBOARDING_TERMS = ("fica", "kyc", "onboard", "identity_verification")

# --- fixed values: flag identifiers, in output order ---
POPIA_FLAGS = ("POPIA_PERSONAL_DATA", "POPIA_SECTION_22", "POPIA_CROSS_BORDER", "POPIA_OPERATOR")
CYBER_FLAGS = ("CYBERCRIMES_ACT_REPORTABLE", "SAPS_REFERRAL", "SARB_REPORTABLE")
PATTERN_FLAGS = (
    "ESKOM_SOCIAL_ENG", "GOVPORTAL_CREDENTIAL_STUFFING", "MOBILE_MONEY_FRAUD",
    "MUNICIPALITY_RANSOMWARE", "FICA_BYPASS_ATTEMPT",
)

# --- fixed values: ATT&CK technique ids attached to each regional pattern ---
PATTERN_TECHNIQUES = {
    "ESKOM_SOCIAL_ENG": ("T1566.001", "T1566.002", "T1598.003"),
    "GOVPORTAL_CREDENTIAL_STUFFING": ("T1110.004", "T1078", "T1087"),
    "MOBILE_MONEY_FRAUD": ("T1598.004", "T1056", "T1078"),
    "MUNICIPALITY_RANSOMWARE": ("T1486", "T1021.002", "T1490", "T1078"),
    "FICA_BYPASS_ATTEMPT": ("T1585", "T1586", "T1078"),
}

# --- fixed values: knowledge-base collections and their display labels ---
COLLECTIONS = {
    "mitre_attack": "MITRE ATT&CK",
    "sa_threat_intel": "SA Threat Intelligence",
    "sa_compliance": "SA Compliance",
}

# --- fixed values: ingest limits ---
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TEXT_CHARS = 50_000
BINARY_SAMPLE_BYTES = 4096
UPLOAD_SOURCES = {".csv": "csv", ".xlsx": "excel", ".xls": "excel"}
# leading bytes of executables, PDF, ZIP, ELF, PNG, JPEG and GIF files
BINARY_MAGIC = (
    b"MZ", b"%PDF-", b"PK\x03\x04", b"\x7fELF", b"\x89PNG", b"\xff\xd8\xff", b"GIF87a", b"GIF89a",
)

# --- fixed values: generated-report contract ---
REPORT_KEYS = (
    "confidence_level", "cybercrimes_flags", "incident_next_steps", "incident_summary",
    "mitre_techniques", "popia_flags", "rag_sources_used", "sa_patterns_matched",
)
REPORT_LISTS = tuple(k for k in REPORT_KEYS if k not in ("confidence_level", "incident_summary"))
CONFIDENCE_LEVELS = ("High", "Medium", "Low")
TECHNIQUE_ENTRY = r"^T\d{4}(\.\d{3})?(?=\s|\(|$)"
STEP_PADDING = "No further action identified."
STEP_COUNT = 4

# --- fixed values: default texts ---
DEFAULT_QUERY = "Cybersecurity incident investigation"
NO_OBLIGATIONS = "No immediate compliance obligations identified."
