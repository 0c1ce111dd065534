"""Convert and check flat record data at dataset scale with Spark."""

from .functions.errors import Cancelled, InvalidInput
from .operators.ledger import usage_counts
from .plans.actions import ACTIONS, catalogue
from .plans.pipelines import Conversion, cancel, convert, csv_to_json, format_json, json_to_csv
from .session import configure, release
from .sinks.commits import recover
from .sinks.documents import saved_documents
from .sources.csv_files import scan_csv
from .sources.json_files import scan_json, scan_json_lines
from .streaming.drop_folder import drop_folder

__all__ = [
    "ACTIONS",
    "Cancelled",
    "Conversion",
    "InvalidInput",
    "cancel",
    "catalogue",
    "configure",
    "convert",
    "csv_to_json",
    "drop_folder",
    "format_json",
    "json_to_csv",
    "recover",
    "release",
    "saved_documents",
    "scan_csv",
    "scan_json",
    "scan_json_lines",
    "usage_counts",
]
