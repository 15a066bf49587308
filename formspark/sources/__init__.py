"""Reading sheets, catalogs, JSON and file lists as tables; writing results."""
