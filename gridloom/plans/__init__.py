"""Plans registered with the driver: queries over the test tables and the SQL they are held against."""
