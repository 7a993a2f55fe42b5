"""Reading and writing of survey, site and weather tables."""
