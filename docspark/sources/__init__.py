"""Sources and sinks."""

from .pdf import from_binary, parsed_tables, read_pdfs, read_pdfs_stream, register_data_source, validate
from .sinks import write_files

__all__ = ["from_binary", "parsed_tables", "read_pdfs", "read_pdfs_stream", "register_data_source", "validate", "write_files"]
