"""Keyword vocabularies for text-derived labels.

All matches are plain *substring* matches on lower-cased text, on purpose:
"abs" fires inside "absorber", "rack" inside "crack", "light" inside
"slight".  No word boundaries are added.
"""

# ---------------------------------------------------------------------------
# These lists must equal the reference's dictionaries, in the
# reference's order (order decides ties and overwrite precedence).
# ---------------------------------------------------------------------------

# Affected component -> keywords (multi-label; output sorted, ", "-joined).
COMPONENT_KEYWORDS = {
    "engine": ["engine", "dpf", "timing belt", "pulley", "water pump", "oil", "coolant", "motor",
               "cylinder", "piston", "crankshaft", "valve", "head gasket", "turbo"],
    "transmission": ["transmission", "gear", "clutch", "trans", "drive shaft", "gearbox",
                     "differential", "flywheel", "synchro"],
    "brake": ["brake", "abs", "rotor", "caliper", "brake pad", "brake fluid", "brake disc",
              "brake drum", "brake line"],
    "electrical": ["electrical", "battery", "light", "cigar lighter", "cigarette lighter", "aircon",
                   "wiring", "fuse", "relay", "switch", "sensor", "starter", "alternator", "ecu"],
    "suspension": ["suspension", "shock", "absorber", "mounting", "link rod", "strut", "spring",
                   "bushing", "ball joint", "control arm", "stabilizer"],
    "tire": ["tyre", "tire", "wheel", "rim", "alignment", "balancing", "puncture", "flat"],
    "exhaust": ["exhaust", "dpf", "regen", "muffler", "catalytic", "emission", "silencer"],
    "fuel": ["fuel", "diesel", "petrol", "gas", "injector", "carburetor", "tank", "pump", "filter"],
    "cooling": ["coolant", "radiator", "water pump", "thermostat", "fan", "hose", "temperature",
                "overheat"],
    "steering": ["steering", "power steering", "rack", "tie rod", "steering wheel",
                 "steering column", "steering pump"],
}

# Severity level -> indicator keywords; score = distinct hits x weight.
SEVERITY_KEYWORDS = {
    "high": ["urgent", "emergency", "critical", "severe", "dangerous", "immediate", "safety",
             "broken", "failed", "not working", "breakdown", "accident", "collision",
             "smoke", "fire", "overheat", "stall", "stuck", "dead", "major", "serious"],
    "medium": ["repair", "replace", "fix", "check", "inspect", "warning", "attention",
               "maintenance", "service", "worn", "noise", "vibration", "leak", "loose",
               "adjustment", "alignment", "update"],
    "low": ["monitor", "observe", "note", "clean", "minor", "cosmetic", "scratch",
            "polish", "touch up", "routine", "normal", "regular", "standard"],
}
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
SEVERITY_DEFAULT = "medium"

# Rule cascade (first match wins): (category, description keywords, Cat codes).
CATEGORY_RULES = [
    ("Maintenance", ["service"], ["SERVICE"]),
    ("Breakdown", ["breakdown"], ["TYREBD"]),
    ("Inspection", ["inspect", "check"], []),
    ("Repair", ["repair", "replace"], ["REPAIR"]),
]
CATEGORY_DEFAULT = "Other"

# Keyword categories over complaint + description (last match wins).
FAULT_CATEGORY_KEYWORDS = {
    "Engine": ["engine", "motor", "cylinder", "piston", "fuel", "oil leak", "coolant"],
    "Transmission": ["transmission", "gear", "clutch", "differential"],
    "Electrical": ["battery", "electrical", "wire", "fuse", "light", "sensor"],
    "Brakes": ["brake", "abs", "rotor", "pad"],
    "Suspension": ["suspension", "shock", "strut", "spring", "steering", "wheel", "tire"],
    "Body": ["body", "door", "window", "paint", "dent", "scratch"],
    "Maintenance": ["service", "maintenance", "inspection", "oil change", "filter"],
}
FAULT_CATEGORY_DEFAULT = "Other"

# Categories a model-based classifier may answer with (from the prompt).
MODEL_CATEGORIES = ["Engine", "Transmission", "Electrical", "Brakes", "Suspension", "Body",
                    "Maintenance"]
# --------------------------------------------------------------------------- end of fixed values
