"""Training-data operators; nothing else in leafmill imports this subpackage."""
