"""Jobs that wire tables to operators."""
