"""Part of the analytics engine; see the README for the layout."""
