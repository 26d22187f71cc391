"""Table sources, fixture derivations, file/JSON sources and sinks."""
