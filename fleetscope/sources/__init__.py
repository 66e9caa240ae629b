"""Sections: schemas, readers for files, bundles and databases, and sinks."""
