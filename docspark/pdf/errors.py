"""What can go wrong with a document, by code."""

from __future__ import annotations


class PdfError(Exception):
    """code: malformed_pdf, password_required_or_incorrect, unsupported_security_handler, page_out_of_range, budget_exceeded, backend_error or internal."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


def malformed(message: str) -> PdfError:
    return PdfError("malformed_pdf", message)


def page_out_of_range(page: int) -> PdfError:
    return PdfError("page_out_of_range", f"page {page} is out of range")


#: The HTTP status of each code; a backend's message is not shown.
STATUS = {
    "malformed_pdf": 400, "password_required_or_incorrect": 422, "unsupported_security_handler": 422, "page_out_of_range": 422, "budget_exceeded": 413, "backend_error": 502, "internal": 500,
    "not_a_pdf": 400, "bad_options": 400, "missing_options": 400, "bad_multipart": 400, "expected_one_file": 400, "expected_multiple_files": 400, "empty_ranges": 400, "invalid_degrees": 400, "not_implemented": 501,
}
