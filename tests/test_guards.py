"""Driver connection strings: the form in which Spark users name a database."""

import pytest

from tessera.sources.guards import NonLocalEndpointError, require_local_uri


@pytest.mark.parametrize(
    "uri",
    [
        "jdbc:postgresql://remote/db", "JDBC:postgresql://remote:5432/db", " jdbc:mysql:replication://localhost,evil.example/db", "jdbc:postgresql://localhost/db?host=evil.example",
        "jdbc:sqlserver://evil.example;databaseName=x", "jdbc:oracle:thin:@evil.example:1521:sid", "jdbc:", "jdbc:h2:tcp:evil.example", "jdbc:postgresql:db?host=evil.example", "jdbc:sqlserver://localhost;host=evil.example",
        "jdbc:postgresql://localhost\\@evil.example/db",
    ],
)
def test_remote_databases_are_refused(uri):
    with pytest.raises(NonLocalEndpointError):
        require_local_uri(uri)


@pytest.mark.parametrize("uri", ["jdbc:postgresql://localhost/db", "jdbc:postgresql://127.0.0.1:5432/db?user=u", "jdbc:sqlserver://localhost:1433;databaseName=x", "jdbc:sqlite:/data/x.db", "jdbc:h2:mem:test", "jdbc:mysql://[::1]:3306/db"])
def test_local_databases_are_not(uri):
    assert require_local_uri(uri) == uri
