"""DataFrame to DataFrame operators of the data-preparation and catalog library."""
