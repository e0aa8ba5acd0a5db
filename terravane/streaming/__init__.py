"""Views of the operators as streams."""
