"""Reports and files made from profiles."""
