"""Declarative format specs (S16) and the format registry.

A spec is plain driver-side data: the column list of a sheet layout, which
columns are required, which transforms run in which order.  It is turned into
a rename map and a ``StructType`` once on the driver; nothing here touches
rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    name: str            # header text as it appears in the sheet
    key: str             # canonical attribute name
    type: str = "string"  # string | integer | datetime | float
    required: bool = False

    @property
    def ident(self) -> str:
        """Column identifier of the header text (see ``header_ident``)."""
        return header_ident(self.name)


@dataclass(frozen=True)
class FormatSpec:
    domain: str
    name: str
    columns: tuple[ColumnSpec, ...]
    sheets: tuple[str, ...] = ()
    header_row: int = 0
    required_columns: tuple[str, ...] = ()
    date_format: str = "%Y-%m-%d %H:%M:%S"
    transformations: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    detect_marker: str = "WO No"
    settings: dict = field(default_factory=dict)

    # -- derived, driver side -------------------------------------------------
    def required_names(self) -> list[str]:
        """Header names flagged ``required`` in the column list."""
        return [c.name for c in self.columns if c.required]

    def rename_map(self) -> dict[str, str]:
        """Header identifier -> canonical key."""
        return {c.ident: c.key for c in self.columns}

    def key_of(self, header_name: str) -> str:
        """Canonical key for a header name; unmapped names come back unchanged."""
        for c in self.columns:
            if c.name == header_name:
                return c.key
        return header_name

    def column(self, key: str) -> ColumnSpec:
        for c in self.columns:
            if c.key == key:
                return c
        raise KeyError(key)

    def schema(self) -> T.StructType:
        """Typed schema of the canonical columns."""
        return T.StructType([T.StructField(c.key, SPARK_TYPES[c.type], True) for c in self.columns])

    def with_(self, **kw) -> "FormatSpec":
        return replace(self, **kw)


SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),  # Python int is unbounded; 64 bits is the closest
    "datetime": T.TimestampType(),
    "float": T.DoubleType(),
}


def header_ident(name: str) -> str:
    """Header text -> safe column identifier: lower case, runs of other
    characters become one underscore ("SRR No." -> "srr_no")."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


# ---------------------------------------------------------------------------
# The maintenance work-order ("kardex") layout.  Header names,
# keys, declared types, required flags, sheet names, header row, validation
# settings and transform order must equal the reference's format file.
# ---------------------------------------------------------------------------
KARDEX_COLUMNS = (
    ColumnSpec("WO No", "work_order", "string", True),
    ColumnSpec("Loc", "location", "string", False),
    ColumnSpec("ST", "status", "string", False),
    ColumnSpec("Mileage", "mileage", "integer", False),
    ColumnSpec("Open Date", "date", "datetime", True),
    ColumnSpec("Done Date", "completion_date", "datetime", False),
    ColumnSpec("Actual Finish Date", "actual_finish_date", "datetime", False),
    ColumnSpec("Nature of Complaint", "nature_of_complaint", "string", True),
    ColumnSpec("Fault Codes", "fault_codes", "string", False),
    ColumnSpec("Job Description", "description", "string", True),
    ColumnSpec("SRR No.", "srr_number", "string", False),
    ColumnSpec("Mechanic Name", "mechanic", "string", False),
    ColumnSpec("Customer", "customer_id", "string", False),
    ColumnSpec("Customer Name", "customer_name", "string", False),
    ColumnSpec("Recommendation 4 next", "next_recommendation", "string", False),
    ColumnSpec("Cat", "category", "string", False),
    ColumnSpec("Lead Tech", "lead_technician", "string", False),
    ColumnSpec("Bill No.", "bill_number", "string", False),
    ColumnSpec("Intercoamt", "interco_amount", "float", False),
    ColumnSpec("Custamt", "cost", "float", False),
)
KARDEX_SHEETS = ("Lifestyle (6yrs)", "10 ft (6yrs)", "14 ft (6yrs)", "16 ft (6yrs)", "24 ft (6yrs)")
KARDEX_HEADER_ROW = 3
KARDEX_REQUIRED = ("WO No", "Open Date", "Job Description", "Nature of Complaint")
KARDEX_DATE_FORMAT = "%Y-%m-%d %H:%M:%S"
KARDEX_TRANSFORMS = (
    "clean_work_order",
    "format_dates",
    "clean_description",
    "extract_severity_from_description",
    "extract_component_from_description",
    "classify_fault_category",
)
KARDEX_ATTRIBUTES = (
    "work_order", "location", "status", "mileage", "date", "completion_date",
    "actual_finish_date", "nature_of_complaint", "fault_codes", "description",
    "srr_number", "mechanic", "customer_id", "customer_name", "next_recommendation",
    "category", "lead_technician", "bill_number", "interco_amount", "cost",
    "severity", "component", "fault_category",
)
KARDEX_SETTING_CATEGORIES = (
    "Engine System", "Transmission System", "Brake System", "Electrical System",
    "Hydraulic System", "Suspension System", "Body and Structure", "Accessories",
    "Preventive Maintenance", "Others",
)
# Required columns of the row-loop reader: the same four, in its own order.
ROW_READER_REQUIRED = ("WO No", "Open Date", "Nature of Complaint", "Job Description")
# The fault-table reader requires every source column (its 21st, the keyword
# category, is derived here instead of being required; see SURVEY C9).
FAULT_TABLE_REQUIRED = tuple(c.name for c in KARDEX_COLUMNS)
# Upload admission: allowed last suffixes, compared lower-cased.
ALLOWED_EXTENSIONS = ("pdf", "xlsx", "xls")
EXCEL_EXTENSIONS = ("xlsx", "xls")
# Positional layout of the generic sheet stacker: the vehicle-type cell and the
# first body row, as 0-based sheet rows.
GENERIC_VEHICLE_TYPE_CELL = (3, 0)
GENERIC_BODY_START_ROW = 5
# --------------------------------------------------------------------------- end of fixed values

KARDEX = FormatSpec(
    domain="vehicle_leasing",
    name="kardex",
    columns=KARDEX_COLUMNS,
    sheets=KARDEX_SHEETS,
    header_row=KARDEX_HEADER_ROW,
    required_columns=KARDEX_REQUIRED,
    date_format=KARDEX_DATE_FORMAT,
    transformations=KARDEX_TRANSFORMS,
    attributes=KARDEX_ATTRIBUTES,
    settings={"fault_categories": KARDEX_SETTING_CATEGORIES},
)

_REGISTRY: dict[tuple[str, str], FormatSpec] = {}


def register_format(spec: FormatSpec) -> FormatSpec:
    """Register a spec under (domain, name); names compare case-insensitively."""
    if not spec.attributes:
        raise ValueError(f"the spec of {spec.domain} names no attributes")
    _REGISTRY[(spec.domain.lower(), spec.name.lower())] = spec
    return spec


def get_format(name: str, domain: str = "vehicle_leasing") -> FormatSpec:
    """Look up a registered spec; unknown domain or format raises ValueError."""
    if not any(d == domain.lower() for d, _ in _REGISTRY):
        raise ValueError(f"no format is registered for {domain}")
    spec = _REGISTRY.get((domain.lower(), name.lower()))
    if spec is None:
        raise ValueError(f"{domain} has no format {name}")
    return spec


def registered_formats() -> list[tuple[str, str]]:
    return sorted(_REGISTRY)


register_format(KARDEX)
