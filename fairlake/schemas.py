"""The packaged record schemas, as JSON Schema dicts.

Fixed values: field names, types and constraints of the record formats. They are
spelled with a few short names; titles are derived from the field names.
"""

from __future__ import annotations

import json
from pathlib import Path

TEXT = {"type": "string"}
DATE = {"type": "string", "format": "date"}
STAMP = {"type": "string", "format": "date-time"}
LINK = {"type": "string", "format": "uri"}
EMAIL = {"type": "string", "format": "email"}
ORCID = {"type": "string", "format": "uri",
         "pattern": r"^https://orcid.org/[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"}
LOCKED = {"type": "string", "readOnly": True}
INT, NUMBER, FLAG = {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
OPEN_MAP = {"type": "object", "additionalProperties": True}


def choice(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def listing(items: dict, **more) -> dict:
    return {"type": "array", "items": items, **more}


def record(required: str = "", /, all_of: list | None = None, **properties: dict) -> dict:
    out = {"type": "object", "properties": properties}
    if required:
        out["required"] = required.split()
    if all_of:
        out["allOf"] = all_of
    return out


def needs(field: str, values: dict, then: str) -> dict:
    return {"if": {"properties": {field: values}}, "then": {"required": [then]}}


TEXTS = listing(TEXT)
AUDIT = {"created_by": TEXT, "created_date": STAMP, "last_modified_by": TEXT, "last_modified_date": STAMP}
AUDITED = " created_by created_date last_modified_by last_modified_date"
STEWARD = record("name email", name=TEXT, orcid=ORCID, email=EMAIL)
ACCESS = choice("Public", "Embargoed", "Restricted", "Confidential")
SENSITIVITY = choice("Public", "Internal Use Only", "Confidential", "PII/PHI")
PERSONAL = {"enum": ["Confidential", "PII/PHI"]}


def template(name: str) -> dict:
    return {"experiment_template_type": {"type": "string", "const": name, "readOnly": True},
            "experiment_identifier_run_id": LOCKED}


PROJECT_DESCRIPTIVE = record(
    "project_identifier project_title" + AUDITED,
    project_identifier=TEXT, project_title=TEXT, project_description=TEXT,
    principal_investigator=record("name orcid email affiliation", name=TEXT, orcid=ORCID, email=EMAIL, affiliation=TEXT),
    contributing_researchers=listing(record("name role", name=TEXT, role=TEXT, orcid=ORCID, affiliation=TEXT)),
    funding_sources=listing(record("funder_name grant_id", funder_name=TEXT, grant_id=TEXT)),
    originating_institution=TEXT, originating_laboratory=TEXT, data_collection_method_summary=TEXT,
    project_data_storage_strategy=TEXT, project_timeline_summary=TEXT, project_keywords=TEXTS,
    project_status=choice("Planning", "Active", "Completed", "On Hold"), **AUDIT)

PROJECT_ADMINISTRATIVE = record(
    "project_identifier_link" + AUDITED,
    all_of=[needs("default_access_level", {"const": "Restricted"}, "default_access_conditions_contact"),
            needs("default_access_level", {"const": "Embargoed"}, "default_embargo_end_date"),
            needs("default_data_sensitivity_classification", PERSONAL, "default_anonymization_method")],
    project_identifier_link=TEXT, data_steward_contact_person=STEWARD, default_license=TEXT,
    default_access_level=ACCESS, default_access_conditions_contact=TEXT, default_embargo_end_date=DATE,
    project_ethics_approval_references=TEXTS, project_consent_framework_summary=TEXT,
    default_data_sensitivity_classification=SENSITIVITY, default_anonymization_method=TEXT,
    project_data_retention_schedule=TEXT, project_citation_template=TEXT, project_documentation_link=LINK,
    project_preservation_location=TEXT, **AUDIT)

DATASET_ADMINISTRATIVE = record(
    "dataset_identifier_link" + AUDITED,
    all_of=[needs("access_level", {"const": "Restricted"}, "access_conditions_contact"),
            needs("access_level", {"const": "Embargoed"}, "embargo_end_date"),
            needs("data_sensitivity_classification", PERSONAL, "anonymization_method")],
    dataset_identifier_link=TEXT, data_steward_contact_person=STEWARD, date_published_released=DATE, license=TEXT,
    access_level=ACCESS, access_conditions_contact=TEXT, embargo_end_date=DATE, ethics_approval_references=TEXTS,
    consent_framework_summary=TEXT, data_sensitivity_classification=SENSITIVITY, anonymization_method=TEXT,
    data_retention_schedule=TEXT, recommended_citation=TEXT, link_to_documentation=LINK,
    preservation_location=TEXT, **AUDIT)

FILE_DESCRIPTION = record(
    "file_name role file_path file_extension file_size_bytes file_created_utc file_modified_utc file_type_os",
    file_name=TEXT, role=TEXT, file_path=TEXT, file_description=TEXT, file_extension=TEXT,
    file_size_bytes={"type": "integer", "minimum": 0}, checksum=TEXT, checksum_algorithm=TEXT, file_type_os=TEXT,
    file_permissions=TEXT, file_accessed_utc=STAMP, file_created_utc=STAMP, file_modified_utc=STAMP,
    file_metadata_changed_utc=STAMP, data_format_standard=TEXT, mime_type=TEXT, encoding=TEXT, dimensions=TEXT,
    bit_depth=TEXT, number_of_records=INT, channels=TEXTS, acquisition_software=TEXT)

DATASET_STRUCTURAL = record(
    "dataset_identifier dataset_title associated_project_identifier" + AUDITED,
    dataset_identifier=TEXT, dataset_title=TEXT, dataset_abstract_description=TEXT, dataset_version=TEXT,
    dataset_type=TEXT, dataset_keywords=TEXTS, associated_project_identifier=TEXT, date_created=DATE,
    related_publications=TEXTS, file_descriptions=listing(FILE_DESCRIPTION, minItems=0),
    data_structure_description=TEXT, link_to_data_dictionary=LINK, data_compression_method=TEXT,
    software_to_read_access_data=listing(record("name", name=TEXT, version=TEXT)), **AUDIT)

EXPERIMENT_CONTEXTUAL = record(
    "experiment_template_type experiment_identifier_run_id" + AUDITED,
    **template("system_default"), experiment_name=TEXT, experiment_dates=listing(DATE),
    experimenters=listing(record("name", name=TEXT, orcid=ORCID)), dataset_identifier_link=TEXT,
    protocol_references=TEXTS, protocol_deviations=TEXT, unique_sample_batch_identifiers=TEXTS,
    sample_source_description=TEXT, sample_treatment_conditions=TEXT, sample_preparation_details=TEXT,
    instrument_used_link=TEXTS, instrument_settings_run_parameters=OPEN_MAP,
    software_used_acquisition_analysis=listing(record("name version", name=TEXT, version=TEXT)),
    software_parameters_script_used=TEXT,
    reagent_kit_details=listing(record("manufacturer catalog_number lot_number", manufacturer=TEXT,
                                       catalog_number=TEXT, lot_number=TEXT, expiry_date=DATE)),
    quality_control_metrics=OPEN_MAP, qc_assessment=choice("Pass", "Fail", "Review", "Warning"),
    links_to_raw_data_files=listing(LINK), experimenter_notes_observations=TEXT, **AUDIT)

GENOMICS_SEQUENCING = record(
    "experiment_template_type experiment_identifier_run_id experiment_title sequencing_platform sequencing_type created_date",
    **template("genomics_sequencing"), experiment_title=TEXT,
    sequencing_platform=choice("Illumina", "PacBio", "Oxford Nanopore", "Other"),
    sequencing_type=choice("Whole Genome", "Exome", "RNA-Seq", "ChIP-Seq", "Other"),
    read_length=INT, coverage=NUMBER, sample_count=INT, library_preparation=TEXT,
    quality_control=record(fastqc_passed=FLAG, adapter_trimming=FLAG, quality_threshold=INT),
    created_date=STAMP, researcher=TEXT, notes=TEXT)

MICROSCOPY_IMAGING = record(
    "experiment_template_type experiment_identifier_run_id experiment_title microscope_type imaging_modality "
    "objective_magnification created_date",
    **template("microscopy_imaging"), experiment_title=TEXT,
    microscope_type=choice("Confocal", "Fluorescence", "Electron", "Phase Contrast", "Bright Field", "Other"),
    imaging_modality=choice("2D", "3D", "Time-lapse", "Z-stack", "Live cell", "Fixed", "Other"),
    objective_magnification=NUMBER, numerical_aperture=NUMBER, pixel_size=NUMBER,
    image_dimensions=record(width=INT, height=INT, channels=INT, timepoints=INT),
    fluorescence_channels=listing(record(channel_name=TEXT, excitation_wavelength=NUMBER,
                                         emission_wavelength=NUMBER, fluorophore=TEXT)),
    sample_preparation=TEXT, imaging_conditions=record(temperature=NUMBER, humidity=NUMBER, co2_level=NUMBER),
    created_date=STAMP, researcher=TEXT, notes=TEXT)

ANNDATA_MUDATA_OBJECT = record(
    "experiment_template_type experiment_identifier_run_id experiment_title created_date object_type "
    "number_of_observations number_of_variables",
    **template("anndata_mudata_object"), experiment_title=TEXT, experiment_description=TEXT,
    data_source=record(source_organism=TEXT, source_tissue=TEXT, sample_preparation_method=TEXT,
                       sequencing_experiment_ids=TEXTS, data_repository_links=TEXTS),
    object_type=choice("AnnData", "MuData"), number_of_observations=INT, number_of_variables=INT,
    observation_annotations=TEXTS, variable_annotations=TEXTS, unstructured_annotations=TEXTS, data_layers=TEXTS,
    modality_information=listing(record(
        "modality_name modality_type number_of_modality_observations number_of_modality_variables",
        modality_name=TEXT, modality_type=TEXT, number_of_modality_observations=INT,
        number_of_modality_variables=INT, assay_protocol=TEXT, feature_type=TEXT, feature_reference=TEXT)),
    data_processing_summary=record(processing_software=TEXTS, processing_workflow_description=TEXT,
                                   normalization_method=TEXT, dimensionality_reduction_methods=TEXTS,
                                   clustering_methods=TEXTS, integration_method=TEXT),
    created_date=STAMP, researcher=TEXT, contact_information=TEXT, notes=TEXT)

INSTRUMENT_TECHNICAL = record(
    "instrument_unique_identifier instrument_type instrument_manufacturer instrument_model key_hardware_specifications" + AUDITED,
    instrument_unique_identifier=TEXT, instrument_type=TEXT, instrument_manufacturer=TEXT, instrument_model=TEXT,
    serial_number=TEXT, key_hardware_specifications=TEXTS, core_software_firmware_version=TEXT, location=TEXT,
    link_to_calibration_maintenance_log=LINK, date_acquired_installed=DATE, **AUDIT)

_RELATION = choice("one_to_many", "one_to_one", "many_to_many")
_SCORE = {"type": "number", "minimum": 0.0, "maximum": 1.0}
_ANY = {"type": "object"}
COMPLETE_METADATA = record(
    "version experiment_identifier metadata_components metadata_relationships metadata_validation metadata_provenance",
    version=choice("2.0"), experiment_identifier=TEXT,
    metadata_components=record(
        "project_descriptive project_administrative dataset_administrative dataset_structural experiment_contextual",
        project_descriptive=_ANY, project_administrative=_ANY, dataset_administrative=_ANY,
        dataset_structural=_ANY, experiment_contextual=_ANY),
    metadata_relationships=record("project_to_dataset dataset_to_experiment experiment_to_data_files",
                                  project_to_dataset=_RELATION, dataset_to_experiment=_RELATION,
                                  experiment_to_data_files=_RELATION),
    metadata_validation=record("schema_compliance completeness_score quality_score", schema_compliance=FLAG,
                               completeness_score=_SCORE, quality_score=_SCORE),
    metadata_provenance=record("generated_by generation_date last_validation_date", generated_by=TEXT,
                               generation_date=STAMP, last_validation_date=STAMP))

# Schema by metadata type, and contextual schema by template name.
BY_TYPE = {
    "project_descriptive": PROJECT_DESCRIPTIVE,
    "project_administrative": PROJECT_ADMINISTRATIVE,
    "dataset_administrative": DATASET_ADMINISTRATIVE,
    "dataset_structural": DATASET_STRUCTURAL,
    "experiment_contextual": EXPERIMENT_CONTEXTUAL,
    "instrument_technical": INSTRUMENT_TECHNICAL,
    "complete_metadata": COMPLETE_METADATA,
}
BY_TEMPLATE = {
    "genomics_sequencing": GENOMICS_SEQUENCING,
    "microscopy_imaging": MICROSCOPY_IMAGING,
    "anndata_mudata_object": ANNDATA_MUDATA_OBJECT,
}

# Schema file of each schema type.
SCHEMA_FILES = {
    "project": "project_descriptive",
    "project_administrative": "project_administrative_schema",
    "dataset_administrative": "dataset_administrative_schema",
    "dataset_structural": "dataset_structural_schema",
    "experiment_contextual": "experiment_contextual_schema",
    "instrument_technical": "instrument_technical_schema",
    "complete_metadata": "complete_metadata_schema",
}


def write_packaged(folder: str) -> None:
    """Writes the packaged schemas as JSON files, the lowest layer of a registry."""
    root = Path(folder)
    (root / "contextual").mkdir(parents=True, exist_ok=True)
    for kind, name in SCHEMA_FILES.items():
        body = BY_TYPE["project_descriptive" if kind == "project" else kind]
        (root / f"{name}.json").write_text(json.dumps({"title": kind.replace("_", " ").title(), **body}))
    for name, body in BY_TEMPLATE.items():
        (root / "contextual" / f"{name}.json").write_text(json.dumps({"title": name.replace("_", " ").title(), **body}))
