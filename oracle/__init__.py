"""Plain SQL twins of the registered queries, used only for checking results."""
