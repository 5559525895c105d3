"""Training-data pipeline operators: search, packing, quality, decontamination, archives, near-duplicates, rollups,
secret and personal-data scans, page extraction. Nothing outside this subpackage imports it."""
