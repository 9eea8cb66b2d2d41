"""Writers of knowledge documents and reports."""
