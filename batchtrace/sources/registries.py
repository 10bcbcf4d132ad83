"""Fixed registries: default partners (S2), vocabularies (Q4) and role permissions.

These are small, bounded literal tables (tens of rows) that the data contract fixes;
they are turned into DataFrames and joined with ``broadcast`` (size is known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------------------
# Default location partners (code, name), in the given order.
# Machine specification is empty for every default partner.
# ---------------------------------------------------------------------------
DEFAULT_PARTNERS = [
    ("AA", "Unknown"),
    ("AB", "Notpla - Machine Unknown"),
    ("AC", "Broadway"),
    ("AD", "Polytechs"),
    ("AE", "PES"),
    ("AF", "Poloplast"),
    ("AG", "Aimplas"),
    ("AH", "Plastribution"),
    ("AI", "Vegeplast"),
    ("AJ", "Viscofan - Cast"),
    ("AK", "Viscofan - Extruded"),
    ("AL", "Notpla - Threetec"),
    ("AM", "Notpla - Leistritz 27mm"),
    ("AN", "ARCHIVED POST BARREL REPLACEMENT Notpla - Boy 22A"),
    ("AO", "Notpla - Collin"),
    ("AP", "Polytechs - Boy 22A"),
    ("AQ", "Polytechs - Maris 51"),
    ("AR", "DeSter"),
    ("AS", "PES - Sapphire, Spoons"),
    ("AT", "Notpla - Boy 22 A"),
    ("AU", "Warwick e-victory 60 ISO 527 Mould"),
    ("AV", "Mclaren - 150 Spoon"),
    ("AX", "Notpla - Engel Victory 210/50 Spex"),
    ("AY", "QUB - Arburg - Family Tool"),
    ("AZ", "QUB - Boy - Clip Tool"),
    ("BA", "Pontacol - 29 L/D Extruder"),
    ("BB", "DAME - Engel 50T"),
    ("BC", "Ecozema - Ice Cream Spoon"),
    ("BD", "Pontacol - Pilot Scale Extruder"),
    ("BE", "Notpla Masterbatch"),
]
# Custom partner codes are allocated from this counter value upwards (BF).
PARTNER_CODE_START = 31

# ---------------------------------------------------------------------------
# Vocabularies.
# ---------------------------------------------------------------------------
FORMAT_VALUES = ["Powder", "Liquid", "Pellet", "Film", "Granules", "Water"]
PACK_UNITS = ["kg", "L"]
PACK_SIZE_RANGE = (1, 1000)
PRODUCT_TYPES = ["PR", "PF", "PI"]
MATERIAL_WORKSTREAM_OPTIONS = [
    "83F1", "High Durability", "Low Viscosity", "Low Cost", "SWS", "GP", "Whole seaweed biomass",
    "Innovation BA project", "BIOMAC", "Inno - high barrier project", "Next Gen Rigid", "Golf Tees",
]
FAILURE_MODES = [
    "N/A", "Under-Plasticized", "Over-Plasticized", "Brittle Filament", "Powder Feed Block",
    "Liquid Feed Block", "Torque Limit", "Pressure Limit", "Barrel Blockage", "Unknown",
    "Sticky Film (direct to film)", "Brittle Film (direct to film)", "Heterogeneity",
]
PURPOSE_OPTIONS = ["Unassigned", "R and D", "Validation", "Production", "Available for Sales",
                   "Sales Reserved", "Sales Sent", "Obsolete and Disposed"]
REFERENCE_SAMPLE_OPTIONS = ["Yes", "No"]
QC_STATUS_OPTIONS = ["Not Requested", "Requested", "Recieved", "Testing Complete"]
BASE_STATUS_OPTIONS = ["Not Requested", "Requested", "Recieved", "Planned", "In Progress", "Complete", "Not received"]
INJECTION_FILM_STATUS_OPTIONS = BASE_STATUS_OPTIONS + ["Failed"]
STORAGE_LOCATION_OPTIONS = ["Notpla", "Expect Warehouse", "FM Warehouse"]
OTHER_STATUS_OPTIONS = ["Not Requested", "Requested", "Planned", "In Progress", "Complete"]
TENSILE_STATUS_OPTIONS = ["Awaiting Moulding", "Ready", "Not Started", "Not Requested", "Planned",
                          "In Progress", "Complete", "Conditioning"]
# The default assignee list is deployment configuration (people's addresses), so it is not
# stored here: ``changes.seed_if_empty`` takes the defaults from the caller.
# Status values that do not belong in a work queue (compared lower-cased and trimmed).
QUEUE_EXCLUDED_STATUSES = ["not requested", "not received", "complete"]
# Page size default and maximum for every paged listing; dashboard and page queue sizes.
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
DASHBOARD_QUEUE_SIZE = 25
PAGE_QUEUE_SIZE = 500
# Request size bounds for bulk minting.
MAX_BAGS_PER_REQUEST = 500
MAX_PRODUCTS_PER_REQUEST = 200


def canonical_status(options: list[str]) -> list[str]:
    """Option list with the legacy 'Recieved' spelling repaired."""
    return ["Received" if o == "Recieved" else o for o in options]


# Status column -> allowed values (after repair); readable queue streams and their assignee columns.
STATUS_VOCAB = {
    "qc_status": canonical_status(QC_STATUS_OPTIONS),
    "long_moisture_status": canonical_status(BASE_STATUS_OPTIONS),
    "density_status": canonical_status(BASE_STATUS_OPTIONS),
    "injection_moulding_status": canonical_status(INJECTION_FILM_STATUS_OPTIONS),
    "film_forming_status": canonical_status(INJECTION_FILM_STATUS_OPTIONS),
}
STATUS_ASSIGNEE = {
    "qc_status": None,
    "long_moisture_status": "long_moisture_assignee_email",
    "density_status": "density_assignee_email",
    "injection_moulding_status": "injection_moulding_assignee_email",
    "film_forming_status": "film_forming_assignee_email",
}
EDITABLE_STATUS_COLUMNS = ["long_moisture_status", "density_status", "injection_moulding_status",
                           "film_forming_status"]

# ---------------------------------------------------------------------------
# Permissions and role groups.
# ---------------------------------------------------------------------------
PERMISSIONS = [
    "ingredients.view", "ingredients.edit", "sets.view", "sets.edit", "dry_weights.view", "dry_weights.edit",
    "batch_selection.view", "batch_selection.edit", "admin.user_roles.view", "admin.user_roles.edit",
    "dashboard.view", "utilities.view", "batches.view", "batches.edit", "location_codes.view",
    "location_codes.edit", "compounding_how.view", "compounding_how.edit", "pellet_bags.view",
    "pellet_bags.edit", "conversion1.view", "conversion1.edit", "status_lists.view", "status_lists.edit",
]
SKU_CODES_PERMISSIONS = [
    "batches.edit", "batches.view", "dashboard.view", "ingredients.edit", "ingredients.view",
    "pellet_bags.view", "sets.edit", "status_lists.edit", "status_lists.view", "utilities.view",
]
FORMULATIONS_PERMISSIONS = [
    "batch_selection.edit", "batch_selection.view", "batches.edit", "batches.view", "dashboard.view",
    "dry_weights.edit", "dry_weights.view", "ingredients.edit", "ingredients.view", "sets.view", "sets.edit",
    "status_lists.edit", "status_lists.view", "utilities.view",
]
FORMULATIONS_MIX_EXTRA = [
    "location_codes.edit", "location_codes.view", "compounding_how.edit", "compounding_how.view",
    "pellet_bags.edit", "pellet_bags.view",
]
MIXING_1_PERMISSIONS = [
    "batch_selection.edit", "batch_selection.view", "batches.edit", "batches.view", "compounding_how.edit",
    "compounding_how.view", "dashboard.view", "dry_weights.edit", "dry_weights.view", "ingredients.edit",
    "ingredients.view", "location_codes.edit", "location_codes.view", "pellet_bags.edit", "pellet_bags.view",
    "sets.edit", "sets.view", "status_lists.edit", "status_lists.view", "utilities.view",
]
ROLE_GROUPS = {
    "sku_codes": SKU_CODES_PERMISSIONS,
    "formulations": FORMULATIONS_PERMISSIONS,
    "formulations_mix": FORMULATIONS_PERMISSIONS + FORMULATIONS_MIX_EXTRA,
    "mixing_1": MIXING_1_PERMISSIONS,
    "admin": PERMISSIONS,
}


def partner_seeds(spark: SparkSession) -> DataFrame:
    """The default partners as a frame (partner_code, partner_name, machine_specification)."""
    return spark.createDataFrame([(c, n, "") for c, n in DEFAULT_PARTNERS],
                                 "partner_code string, partner_name string, machine_specification string")


def role_table(spark: SparkSession) -> DataFrame:
    """(role_group, permission) pairs, one row per granted permission (about 90 rows)."""
    rows = [(r, p) for r, perms in ROLE_GROUPS.items() for p in sorted(set(perms))]
    return spark.createDataFrame(rows, "role_group string, permission string")
