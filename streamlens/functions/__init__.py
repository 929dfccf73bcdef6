"""Part of streamlens; see the README for the layout."""
