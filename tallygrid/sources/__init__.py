"""Files: finding, scanning and writing event tables and cuts."""
