"""Part of terralex; see the README for the layout."""
