"""Name logic on plain Python strings; no Spark imports here."""
