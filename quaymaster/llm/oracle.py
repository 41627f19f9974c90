"""DuckDB SQL beside the queries, written from their contracts."""

MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM rows GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS ceiling, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM sources),
levels AS (
  SELECT *, (wanted - coalesce(sum(ceiling) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
filled AS (
  SELECT source, source_size, least(ceiling, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight, ceiling)) AS target FROM levels),
times AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM filled),
running AS (
  SELECT r.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS more,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place) AS upto
  FROM rows r JOIN times t ON r.source IS NOT DISTINCT FROM t.source),
cuts AS (
  SELECT source, arg_min(place, (abs(upto - more), place)) AS cut, min(abs(upto - more)) AS off, any_value(more) AS more FROM running GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN c.more > 0 AND c.off < c.more AND r.place <= c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""

URL_REPUTATION = r"""
WITH seen AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
labelled AS (
  SELECT s.host, (l.quality = 1 AND coalesce(l.toxic, 0) = 0) AS good FROM seen s LEFT JOIN labels l ON s.page_id = l.doc_id AND l.quality IS NOT NULL),
names AS (
  SELECT host, count(good) AS n, count(*) FILTER (good) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|\.+)$', '') AS name FROM labelled GROUP BY host),
hosts AS (
  SELECT host, n, k,
         CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN name ELSE coalesce(nullif(regexp_extract(name, '(?:^|\.)([^.]+\.(?:(?:(?:co|com|org|net|ac|gov|edu)\.[a-z][a-z])|[^.]+))$', 1), ''), name) END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN name ELSE regexp_extract(name, '(?:^|\.)((?:(?:co|com|org|net|ac|gov|edu)\.[a-z][a-z])|[^.]+)$', 1) END AS suffix
  FROM names),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s1 AS (SELECT *, (sum(k) OVER () + 0.5::DOUBLE) / (sum(n) OVER () + 1.0::DOUBLE) AS m FROM suffixes),
s2 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce((sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.001)))::DOUBLE - 1 AS kappa FROM s1 WHERE n > 0),
s3 AS (SELECT suffix, (kappa * m + k) / (kappa * m + k + kappa * (1 - m) + n - k) AS m FROM s1, s2),
d1 AS (SELECT d.*, s3.m FROM domains d JOIN s3 USING (suffix)),
d2 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce((sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.001)))::DOUBLE - 1 AS kappa FROM d1 WHERE n > 0),
d3 AS (SELECT domain, (kappa * m + k) / (kappa * m + k + kappa * (1 - m) + n - k) AS m FROM d1, d2),
h1 AS (SELECT h.*, d3.m FROM hosts h JOIN d3 USING (domain)),
h2 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce((sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.001)))::DOUBLE - 1 AS kappa FROM h1 WHERE n > 0),
h3 AS (SELECT host, kappa * m + k AS a, kappa * (1 - m) + n - k AS b FROM h1, h2),
fit AS (SELECT host, a / (a + b) + 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h3),
ruled AS (
  SELECT s.*, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen s)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN f.upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN fit f USING (host)
"""
