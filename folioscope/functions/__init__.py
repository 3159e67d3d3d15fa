"""Part of the engine core; see the README for the layout."""
