"""Readers and writers of bundles, manifests, logs, service answers and reports."""
