"""Sources: uploaded files as tables of pages, files and chunks."""
