"""Land and site planning analytics over tables of sites, layouts, plots, roads and assets."""
