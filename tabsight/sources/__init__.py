"""Tables from files, folders, databases and addresses."""
