"""Readers and writers: tables, directory listings, text manifests, XML and JSON logs."""
