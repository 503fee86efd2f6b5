"""Sources: tables as pages, files as documents."""
