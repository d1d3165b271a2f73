from quire.plans import scans, texts, trees  # noqa: F401
