"""Row order, fingerprints and caches."""
