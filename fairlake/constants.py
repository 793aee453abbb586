"""Names, lists and lookups that results must agree on."""

PROJECT_PREFIX = "p_"
DATASET_PREFIX = "d_"
METADATA_DIR = ".metadata"
PLACEHOLDER = "To be filled"

# Path parts that hide a file from the catalog.
IGNORED_SYSTEM_NAMES = [
    ".git", ".dvc", "__pycache__", ".DS_Store", "node_modules", ".venv",
    "venv", "env", "dist", "build", ".next",
]
IGNORED_TEMP_MARKS = [".tmp", ".swp", ".swo", "~", ".bak"]
IGNORED_METADATA_SUFFIXES = [".json", ".md", ".txt"]
TEMPLATE_SCHEMA_DIR = ".template_schemas"

# MIME type by lower-case suffix.
MIME_TYPES = {
    ".txt": "text/plain", ".csv": "text/csv", ".json": "application/json",
    ".xml": "application/xml", ".html": "text/html", ".htm": "text/html",
    ".css": "text/css", ".js": "application/javascript", ".py": "text/x-python",
    ".md": "text/markdown", ".pdf": "application/pdf", ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif",
    ".svg": "image/svg+xml", ".zip": "application/zip", ".tar": "application/x-tar",
    ".gz": "application/gzip", ".bz2": "application/x-bzip2",
}
DEFAULT_MIME_TYPE = "application/octet-stream"

# Compression by lower-case suffix.
COMPRESSIONS = {
    ".gz": "gzip", ".bz2": "bzip2", ".zip": "zip", ".tar": "tar",
    ".7z": "7zip", ".rar": "rar",
}

# Defaults of a file fact.
DEFAULT_PERMISSIONS = "-rw-r--r--"
MIN_FILE_BYTES = 10

# Identifier and payload limits.
MAX_ID_LENGTH = 100
MAX_TYPE_LENGTH = 50
MAX_PAYLOAD_BYTES = 1024 * 1024
ID_PATTERN = r"^[a-zA-Z0-9_-]+$"
METADATA_TYPES = [
    "project_descriptive", "dataset_administrative", "dataset_structural",
    "experiment_contextual", "instrument_technical", "complete_metadata",
]
SCHEMA_TYPES = [
    "project", "dataset_administrative", "dataset_structural",
    "experiment_contextual", "instrument_technical", "complete_metadata",
    "contextual",
]

# Identifiers a client may not change, by metadata type.
PROTECTED_FIELDS = {
    "project_descriptive": ["project_identifier"],
    "dataset_structural": ["dataset_identifier", "associated_project_identifier"],
    "dataset_administrative": ["dataset_identifier_link", "associated_project_identifier"],
    "experiment_contextual": [
        "experiment_template_type", "experiment_identifier_run_id", "dataset_identifier_link",
    ],
}
AUDITED_TYPES = ["project_descriptive", "project_administrative", "experiment_contextual"]

# Project default -> dataset field it fills.
INHERITED_FIELDS = {
    "data_steward_contact_person": "data_steward_contact_person",
    "default_license": "license",
    "default_access_level": "access_level",
    "default_access_conditions_contact": "access_conditions_contact",
    "default_embargo_end_date": "embargo_end_date",
    "project_ethics_approval_references": "ethics_approval_references",
    "project_consent_framework_summary": "consent_framework_summary",
    "default_data_sensitivity_classification": "data_sensitivity_classification",
    "default_anonymization_method": "anonymization_method",
    "project_data_retention_schedule": "data_retention_schedule",
    "project_citation_template": "recommended_citation",
    "project_documentation_link": "link_to_documentation",
    "project_preservation_location": "preservation_location",
}

# Required fields that the completion gate does not look at.
GATE_IGNORED_FIELDS = [
    "created_by", "created_date", "last_modified_by", "last_modified_date",
    "experiment_template_type",
]

# Component relationships in a complete record.
RELATIONSHIPS = {
    "project_to_dataset": "one_to_many",
    "dataset_to_experiment": "one_to_many",
    "experiment_to_data_files": "one_to_many",
}
COMPONENT_TYPES = [
    "project_descriptive", "project_administrative", "dataset_administrative",
    "dataset_structural", "experiment_contextual",
]

# Placeholder text for patterned fields.
PLACEHOLDER_BY_NAME = {
    "orcid": "https://orcid.org/0000-0000-0000-0000",
    "email": "placeholder@example.com",
}

# Role permissions and the permission each endpoint needs.
ROLE_PERMISSIONS = {
    "admin": ["read", "write", "delete", "manage"],
    "editor": ["read", "write"],
    "viewer": ["read"],
}
ENDPOINT_PERMISSIONS = {
    "GET /api/v1/projects": "read",
    "GET /api/v1/projects/{project_id}/datasets": "read",
    "GET /api/v1/schemas/contextual": "read",
    "GET /api/v1/schemas/{schema_type}/{schema_id}": "read",
    "GET /api/v1/projects/{project_id}/metadata/{metadata_type}": "read",
    "GET /api/v1/datasets/{dataset_id}/metadata/{metadata_type}": "read",
    "GET /api/v1/health": "read",
    "POST /api/v1/rescan": "manage",
    "PUT /api/v1/projects/{project_id}/metadata/{metadata_type}": "write",
    "PUT /api/v1/datasets/{dataset_id}/metadata/{metadata_type}": "write",
    "POST /api/v1/datasets/{dataset_id}/contextual": "write",
    "POST /api/v1/datasets/{dataset_id}/finalize": "write",
    "POST /api/v1/config/reload": "manage",
}

# Thresholds of the log reports.
SLOW_REQUEST_MS = 1000
LOW_HIT_RATE = 0.5
REPORT_PERCENTILES = [50, 90, 95, 99]
FAILURE_OUTCOMES = ["failure", "connection_error"]
REQUEST_LOGGER = "api_stresser"
REQUEST_MESSAGE = "API request completed"

# Form sections by metadata type: id -> (substrings, exact names).
FORM_SECTIONS = {
    "experiment_contextual": {
        "experiment_info": (["experiment_", "protocol_"], ["experimenters", "experiment_dates"]),
        "sample_info": (["sample_", "batch_"], ["unique_sample_batch_identifiers"]),
        "instrumentation": (
            ["instrument_", "software_", "sequencing_", "microscope_", "imaging_",
             "objective_", "reagent_"], []),
        "quality_data": (["quality_", "qc_", "data_", "links_", "raw_"], []),
        "notes_metadata": (
            ["notes", "observations", "created_", "modified_", "identifier"],
            ["dataset_identifier_link"]),
    },
    "dataset_administrative": {
        "basic_info": (["title", "description", "identifier", "version"], []),
        "people_organizations": (
            ["creator", "contributor", "contact", "organization", "affiliation"], []),
        "dates_lifecycle": (["date", "created", "modified", "published"], []),
        "access_rights": (["license", "rights", "access", "embargo"], []),
    },
    "dataset_structural": {
        "structure": (["format", "type", "structure", "schema"], []),
        "files_storage": (["file", "path", "storage", "location"], []),
        "technical": (["encoding", "compression", "checksum", "size"], []),
    },
}
