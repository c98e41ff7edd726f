"""Vocabularies and field names whose content results depend on."""

from __future__ import annotations

#: Words left out of phrases.
STOPWORDS = "a an and are as at by for from in into is of on or the to with".split()

#: Whole terms that stand for another.
SYNONYMS = {
    "comma separated values": "csv",
    "text csv": "csv",
    "csv file": "csv",
    "rest api": "api",
    "web service": "api",
    "arcgis rest service": "api",
    "download link": "download url",
    "file link": "download url",
    "file url": "download url",
    "csv url": "download url",
    "api endpoint": "access url",
    "endpoint url": "access url",
    "service url": "access url",
    "tag": "keyword",
    "topic": "keyword",
    "subject": "keyword",
    "keywords": "keyword",
    "motor vehicle collision": "traffic crash",
    "vehicle collision": "traffic crash",
    "road accident": "traffic crash",
    "traffic accident": "traffic crash",
}

#: Columns that terms are taken from, in this order.
TERM_FIELDS = (
    "title notes tags groups organization_title organization_name resource_names resource_formats resource_media_types "
    "dcat_keyword dcat_theme dcat_publisher_name distribution_titles distribution_formats distribution_media_types"
).split()
#: Those of them whose values are lists.
COMPOUND_FIELDS = (
    "tags groups resource_names resource_formats resource_media_types dcat_keyword dcat_theme distribution_titles "
    "distribution_formats distribution_media_types"
).split()

#: Terms that are never clustered.
EXCLUDED_TERMS = [
    "access url",
    "download url",
    "original metadata",
    "web page",
    "text html",
    "application json",
    "application zip",
    "application octet stream",
    "this dataset",
    "digital data",
    "united states",
    "department",
    "data gov",
]
#: Parts of terms about sensors and telemetry.
SENSOR_TERMS = [
    "sensor",
    "sensors",
    "telemetry",
    "monitoring",
    "streamgage",
    "stream gage",
    "streamflow",
    "real time",
    "realtime",
    "device",
    "station",
    "uas",
    "uav",
    "drone",
    "observation",
    "environmental monitoring",
    "water quality",
]
#: Terms that are mere streams of bytes.
NOISY_STREAMS = ["application octet stream", "octet stream", "stream"]
#: Words too common to block on.
BLOCK_STOP_TOKENS = (
    "data dataset datasets file files resource resources service services state states county city public national "
    "information metadata system systems program project report reports map maps"
).split()

#: Field names that stand for a field of the standard vocabulary.
FIELD_ALIASES = {
    "name": "title",
    "dataset_name": "title",
    "notes": "description",
    "summary": "description",
    "abstract": "description",
    "overview": "description",
    "description_text": "description",
    "tags": "keyword",
    "topics": "keyword",
    "subjects": "keyword",
    "keywords_list": "keyword",
    "modified_at": "modified",
    "last_updated": "modified",
    "update_date": "modified",
    "date_modified": "modified",
    "agency": "publisher",
    "publisher_name": "publisher",
    "organization": "publisher",
    "contact_email": "contactPoint.hasEmail",
    "maintainer_email": "contactPoint.hasEmail",
    "download_link": "distribution.downloadURL",
    "file_url": "distribution.downloadURL",
    "csv_url": "distribution.downloadURL",
    "api_endpoint": "distribution.accessURL",
    "service_url": "distribution.accessURL",
    "endpoint_url": "distribution.accessURL",
}
#: Fields that a catalog entry should have.
REQUIRED_FIELDS = ["description", "keyword", "modified", "publisher", "title"]

#: Patterns of header names by column role.
ROLE_PATTERNS = {
    "title_field": [r"\btitle\b", r"\bname\b"],
    "description_field": ["desc", "summary", "abstract", "notes?"],
    "time_field": [r"\btime\b", "timestamp", "hour"],
    "date_field": [r"\bdate\b", "created", "modified", "updated"],
    "location_field": ["address", "location", "city", "county", "state", "zip"],
    "latitude_field": [r"\blat\b", "latitude"],
    "longitude_field": [r"\blon\b", r"\blng\b", "longitude"],
    "geometry_field": ["geometry", "geom", "wkt", "shape"],
    "entity_id_field": [r"(^|_)id($|_)", "identifier", "case_number", "record"],
    "category_field": ["category", "type", "class", "group"],
    "status_field": ["status", "state", "outcome", "disposition"],
    "metric_field": ["amount", "value", "score", "rate", "measure"],
    "percentage_field": ["percent", "percentage", r"\bpct\b"],
    "count_field": ["count", "total", "number", r"\bnum\b"],
    "url_field": ["url", "link", "website"],
    "contact_email_field": ["email", "e_mail"],
}

#: Counted groups of sensor words, by label.
SENSOR_PATTERNS = {
    "IoT exact count": ["iot"],
    "sensor count": ["sensor", "sensors"],
    "telemetry count": ["telemetry"],
    "monitoring count": ["monitoring"],
    "real-time count": ["real time", "realtime", "real-time"],
    "streamgage/streamflow count": ["streamgage", "stream gage", "streamflow"],
    "UAS/drone count": ["uas", "uav", "drone"],
}
#: Terms that the sensor summary suggests.
SENSOR_EXPANSIONS = [
    "sensor",
    "sensors",
    "telemetry",
    "environmental monitoring",
    "real-time monitoring",
    "streamgage",
    "stream gage",
    "streamflow",
    "station",
    "observation",
    "water quality",
    "device",
    "UAS",
    "UAV",
    "drone",
]

#: Labels of a review.
VALID_LABELS = ["equivalent", "not_equivalent", "related", "unsure"]

#: File name endings inside archives.
ZIP_SUPPORTED = [".csv", ".xlsx", ".json", ".xml", ".txt", ".geojson"]
ZIP_PROFILED = [".csv", ".xlsx"]
ZIP_SKIPPED = [".shp", ".dbf", ".prj", ".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".zip"]

#: Columns of the result tables.
TERM_COLUMNS = "term normalized_term source_field count example_record_ids example_titles".split()
CLUSTER_COLUMNS = (
    "cluster_id canonical_term observed_term normalized_term source_fields count similarity_score cluster_reason examples"
).split()
#: Fields of the completeness report with the columns that fill them.
COMPLETENESS = {
    "title": ["title", "dcat_title"],
    "description": ["notes", "dcat_description"],
    "identifier": ["dcat_identifier", "id"],
    "accessLevel": ["dcat_accessLevel"],
    "publisher": ["dcat_publisher_name", "organization_name"],
    "contactPoint": ["dcat_contactPoint_hasEmail", "dcat_contactPoint_fn"],
    "keyword": ["dcat_keyword", "tags"],
    "modified": ["dcat_modified", "metadata_modified"],
    "distribution": ["distribution_count", "resources_count"],
    "downloadURL/accessURL": ["distribution_download_urls", "distribution_access_urls", "resource_urls"],
}
