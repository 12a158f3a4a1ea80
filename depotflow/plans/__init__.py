"""Views, lists and document jobs as functions over a mapping of tables."""
