from callsheet.sources.io import CLIENT_FILE_SCHEMA, load_clients, load_table, sql_over, write_table
from callsheet.sources.clients import clients, clients_sql

__all__ = ["CLIENT_FILE_SCHEMA", "load_clients", "load_table", "sql_over", "write_table",
           "clients", "clients_sql"]
