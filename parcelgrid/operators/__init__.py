"""DataFrame-to-DataFrame operators, each over a whole table of sites or layouts."""
