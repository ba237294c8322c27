"""Default rule tables. They are parameters of the operators; these are the values used when none are given."""

from __future__ import annotations

# They must equal the documented rules for right results.
CLOUD_KEYWORDS = {'AWS': ['amazon web services', ' aws ', 'aws.amazon.com', ' ec2 ', ' s3 ', ' ecs ', ' eks ', 'cloudfront', 'dynamodb', 'redshift', 'sagemaker',
         'aws fargate', 'amazon rds', 'amazon aurora', 'amazon sqs', 'amazon sns', 'aws glue', 'amazon kinesis', 'aws cdk'],
 'GCP': ['google cloud', ' gcp ', 'cloud.google.com', 'bigquery', 'gke ', 'google kubernetes', 'cloud spanner', 'vertex ai', 'pub/sub',
         'google compute engine', 'google cloud platform'],
 'Azure': ['microsoft azure', ' azure ', 'azure.microsoft.com', 'azure devops', 'azure functions', 'cosmos db', 'azure blob', 'azure kubernetes',
           ' aks ', 'azure sql', 'azure cognitive', 'azure openai', 'azure ml', 'azure pipelines'],
 'Lambda': ['lambda.cloud', 'lambdalabs.com', 'lambda labs', 'lambda gpu cloud'],
 'Crusoe': ['crusoe.ai', 'crusoe cloud', 'crusoecloud', 'crusoe energy'],
 'OVH': ['ovhcloud', 'ovh cloud', 'ovh.net', 'ovh.com'],
 'Vultr': ['vultr.com', ' vultr '],
 'Paperspace': ['paperspace.com', ' paperspace ', 'gradient.run'],
 'Nebius': ['nebius.ai', 'nebius cloud'],
 'Fluidstack': ['fluidstack.io', ' fluidstack '],
 'On-Premises': ['on-premises', 'on-prem', 'on premise', 'self-hosted infrastructure', 'self hosted infrastructure', 'private datacenter',
                 'private data center', 'own datacenter', 'own data center', 'bare metal', 'colocated', 'colocation', 'colo facility', 'air-gapped',
                 'hpe proliant', 'dell emc', 'lenovo thinksystem']}

AI_KEYWORDS = {'OpenAI': ['openai', 'openai api', 'openai.com', 'chatgpt', 'gpt-4', 'gpt-4o', 'gpt-3', 'gpt-3.5', 'dall-e', 'whisper api', 'o1-preview', 'o1-mini'],
 'Anthropic': ['anthropic', 'anthropic api', 'anthropic.com', 'claude api', 'claude.ai', 'claude 3', 'claude sonnet', 'claude opus', 'claude haiku',
               ' claude '],
 'Google AI': ['vertex ai', 'google ai studio', 'google ai', 'gemini api', 'gemini pro', 'gemini ultra', 'gemini flash', 'gemma ', 'gemini '],
 'Cohere': ['cohere', 'cohere api', 'cohere.ai', 'command-r', 'command r', 'cohere embed', 'cohere generate'],
 'Mistral': ['mistral ai', 'mistral api', 'mistral.ai', 'mixtral', 'mistral-7b', 'mistral-8x', 'mistral '],
 'Meta / Llama': ['llama 3', 'llama3', 'llama 2', 'llama2', 'llama 3.1', 'llama 3.2', 'meta llama', 'meta ai', 'meta.ai', 'llama api', 'llama model'],
 'xAI / Grok': ['xai grok', 'grok api', 'grok-1', 'grok-2', 'x.ai', 'xai.com', 'grok llm'],
 'Hugging Face': ['hugging face', 'huggingface', 'huggingface.co', 'hugging face api', 'inference api', 'transformers library', 'hf inference'],
 'Together AI': ['together ai', 'together.ai', 'together api', 'togetherai'],
 'Replicate': ['replicate.com', 'replicate api'],
 'Groq': ['groq api', 'groq.com', 'groq inference']}

HIRING_PHRASES = ['experience with', 'experience in', 'familiarity with', 'knowledge of', 'proficiency in', 'proficiency with', 'understanding of', 'preferred',
 'bonus if', 'nice to have', 'nice-to-have', 'a plus', 'is a plus', 'would be a plus', 'worked with', 'exposure to']

PROVIDER_TERMS = [('amazon web services', 'cloud', 'AWS', 1.0), (' aws ', 'cloud', 'AWS', 1.0), ('amazon cloud', 'cloud', 'AWS', 1.0), ('amazon', 'cloud', 'AWS', 1.0),
 ('google cloud', 'cloud', 'GCP', 1.0), (' google ', 'cloud', 'GCP', 0.5), ('microsoft azure', 'cloud', 'Azure', 1.0),
 (' azure ', 'cloud', 'Azure', 1.0), ('microsoft', 'cloud', 'Azure', 1.0), ('coreweave', 'cloud', 'CoreWeave', 1.0),
 ('lambda labs', 'cloud', 'Lambda', 1.0), ('lambda.cloud', 'cloud', 'Lambda', 1.0), ('crusoe', 'cloud', 'Crusoe', 1.0),
 ('ovhcloud', 'cloud', 'OVH', 1.0), ('ovh cloud', 'cloud', 'OVH', 1.0), ('vultr', 'cloud', 'Vultr', 1.0), ('paperspace', 'cloud', 'Paperspace', 1.0),
 ('nebius', 'cloud', 'Nebius', 1.0), ('fluidstack', 'cloud', 'Fluidstack', 1.0), ('vast.ai', 'cloud', 'Vast.ai', 1.0),
 ('oracle cloud', 'cloud', 'OCI', 1.0), ('on-premises', 'cloud', 'On-Premises', 0.6), ('on-prem', 'cloud', 'On-Premises', 0.6),
 ('private datacenter', 'cloud', 'On-Premises', 0.6), ('private data center', 'cloud', 'On-Premises', 0.6),
 ('bare metal', 'cloud', 'On-Premises', 0.6), ('air-gapped', 'cloud', 'On-Premises', 1.0), ('openai', 'ai', 'OpenAI', 1.0),
 ('openai api', 'ai', 'OpenAI', 1.0), ('anthropic', 'ai', 'Anthropic', 1.0), ('anthropic api', 'ai', 'Anthropic', 1.0),
 ('claude api', 'ai', 'Anthropic', 1.0), ('claude.ai', 'ai', 'Anthropic', 1.0), ('vertex ai', 'ai', 'Google AI', 1.0),
 ('google ai studio', 'ai', 'Google AI', 1.0), ('gemini api', 'ai', 'Google AI', 1.0), ('cohere', 'ai', 'Cohere', 1.0),
 ('mistral ai', 'ai', 'Mistral', 1.0), ('mistral api', 'ai', 'Mistral', 1.0), ('mixtral', 'ai', 'Mistral', 1.0),
 ('llama 3', 'ai', 'Meta / Llama', 1.0), ('llama 2', 'ai', 'Meta / Llama', 1.0), ('meta llama', 'ai', 'Meta / Llama', 1.0),
 ('llama api', 'ai', 'Meta / Llama', 1.0), ('grok api', 'ai', 'xAI / Grok', 1.0), ('grok-1', 'ai', 'xAI / Grok', 1.0),
 ('grok-2', 'ai', 'xAI / Grok', 1.0), ('hugging face', 'ai', 'Hugging Face', 1.0), ('huggingface', 'ai', 'Hugging Face', 1.0),
 ('together ai', 'ai', 'Together AI', 1.0), ('together.ai', 'ai', 'Together AI', 1.0), ('replicate.com', 'ai', 'Replicate', 1.0),
 ('replicate api', 'ai', 'Replicate', 1.0), ('groq api', 'ai', 'Groq', 1.0), ('groq.com', 'ai', 'Groq', 1.0), (' claude ', 'ai', 'Anthropic', 0.5),
 ('gemini ', 'ai', 'Google AI', 0.5), ('mistral ', 'ai', 'Mistral', 0.5), (' replicate ', 'ai', 'Replicate', 0.5)]

COMPETITOR_SLUGS = ['alternative', '/vs-', '-vs-', '/vs/', 'competitor', 'comparison', 'compare', 'evaluat', 'benchmark', 'best-llm', 'best-ai', 'llm-review',
 'model-review', 'choosing-', 'which-llm', 'which-ai']

HOSTED_CNAMES = ['wixdns.net', 'wix.com', 'squarespace.com', 'sqsp.net', 'webflow.io', 'myshopify.com', 'shopify.com', 'github.io', 'netlify.app', 'netlify.com',
 'vercel.app', 'wpengine.com', 'kinsta.cloud']

OTHER_PLATFORM_CNAMES = {'vercel.app': 'Vercel',
 'vercel-dns.com': 'Vercel',
 'netlify.app': 'Netlify',
 'netlify.com': 'Netlify',
 'onrender.com': 'Render',
 'github.io': 'GitHub Pages',
 'webflow.io': 'Webflow'}

OTHER_PLATFORM_HEADERS = [('server', 'vercel', 'Vercel'), ('x-vercel-id', None, 'Vercel'), ('server', 'netlify', 'Netlify'), ('x-nf-request-id', None, 'Netlify'),
 ('cf-ray', None, 'Cloudflare'), ('server', 'cloudflare', 'Cloudflare'), ('x-render-origin-server', None, 'Render')]

ROLE_KEYWORDS = ['software', 'backend', 'infrastructure', 'platform', 'devops', 'site reliability', ' sre', 'cloud', 'full stack', 'fullstack', 'data engineer',
 'ml engineer', 'machine learning engineer', 'security', 'network engineer', 'data scientist', 'data analyst']

JOB_BOARDS = ['jobs.lever.co', 'boards.greenhouse.io', 'jobs.ashbyhq.com', 'apply.workable.com', 'jobs.gem.com', 'jobs.rippling.com', 'ats.rippling.com',
 'careers.jobvite.com', 'job-boards.greenhouse.io', 'bamboohr.com', 'jobs.smartrecruiters.com', 'icims.com', 'myworkdayjobs.com']

SUBPROCESSOR_CLOUD = {'amazon web services': 'AWS',
 'aws': 'AWS',
 'google cloud': 'GCP',
 'google cloud platform': 'GCP',
 'gcp': 'GCP',
 'google': 'GCP',
 'microsoft azure': 'Azure',
 'microsoft corp': 'Azure',
 'microsoft corporation': 'Azure',
 'microsoft': 'Azure',
 'azure': 'Azure'}

SUBPROCESSOR_AI = {'openai': 'OpenAI',
 'anthropic': 'Anthropic',
 'claude': 'Anthropic',
 'google ai': 'Google AI',
 'vertex ai': 'Google AI',
 'gemini': 'Google AI',
 'google cloud platform': 'Google AI',
 'google cloud': 'Google AI',
 'google': 'Google AI',
 'cohere': 'Cohere',
 'mistral': 'Mistral',
 'aws bedrock': 'AWS Bedrock',
 'amazon bedrock': 'AWS Bedrock',
 'amazon web services': 'AWS Bedrock',
 'aws': 'AWS Bedrock',
 'amazon': 'AWS Bedrock',
 'sagemaker': 'AWS SageMaker',
 'azure openai': 'Azure OpenAI',
 'microsoft azure': 'Azure OpenAI',
 'microsoft corp': 'Azure OpenAI',
 'hugging face': 'Hugging Face',
 'elevenlabs': 'ElevenLabs',
 'eleven labs': 'ElevenLabs',
 'perplexity': 'Perplexity',
 'stability ai': 'Stability AI',
 'stable diffusion': 'Stability AI',
 'together ai': 'Together AI',
 'together': 'Together AI',
 'groq': 'Groq',
 'replicate': 'Replicate',
 'xai': 'xAI',
 'grok': 'xAI'}

INFRASTRUCTURE_PURPOSES = ['cloud infrastructure', 'infrastructure', 'data hosting', 'hosting', 'cloud hosting', 'cloud services', 'cloud provider', 'compute', 'storage',
 'data storage', 'cloud storage', 'data processing', 'analytics', 'network', 'database', 'cdn']

AI_PURPOSES = ['ai service', 'ai provider', 'ai services', 'llm', 'language model', 'machine learning', 'ml', 'natural language', 'generative ai', 'generative',
 'large language', 'inference', 'model training', 'training', 'foundation model', 'ai model']

PARTNERSHIP_OVERRIDES = {'Anthropic': {'cloud': ['GCP', 'AWS'], 'ai': None, 'source_url': 'https://cloud.google.com/customers/anthropic'},
 'OpenAI': {'cloud': 'Azure', 'ai': None, 'source_url': 'https://openai.com/index/openai-and-microsoft-extend-partnership/'},
 'Cohere': {'cloud': 'AWS', 'ai': None, 'source_url': 'https://aws.amazon.com/partners/cohere/'},
 'Apptronik': {'cloud': 'GCP', 'ai': None, 'source_url': 'https://apptronik.com/news-collection/apptronik-partners-with-google-deepmind-robotics'},
 'Axiom Space': {'cloud': 'AWS', 'ai': None, 'source_url': 'https://www.axiomspace.com/release/amazon-web-services-all-in'},
 'Fundamental AI': {'cloud': 'AWS', 'ai': None, 'source_url': 'https://techfundingnews.com/fundamental-255m-nexus-tabular-ai-oak-hcft-aws/'},
 'Upwind': {'cloud': 'AWS', 'ai': None, 'source_url': 'https://www.upwind.io/secure-your-aws-environment-with-upwind'},
 'Runway': {'cloud': 'CoreWeave',
            'ai': None,
            'source_url': 'https://www.coreweave.com/news/coreweave-announces-agreement-to-power-runways-next-generation-ai-video-models'}}

NOT_APPLICABLE = {'Anthropic': {'cloud': None, 'ai': 'Builds proprietary frontier models — not a consumer of external AI providers'},
 'OpenAI': {'cloud': None, 'ai': 'Builds proprietary frontier models — not a consumer of external AI providers'},
 'Cohere': {'cloud': None, 'ai': 'Builds proprietary frontier models — not a consumer of external AI providers'},
 'Pale Blue Dot': {'cloud': 'GPU neocloud marketplace — is itself the compute provider, not a consumer', 'ai': None},
 'CoreWeave': {'cloud': 'Dedicated GPU cloud provider — is itself the compute infrastructure', 'ai': None},
 'Lambda Labs': {'cloud': 'GPU cloud provider — is itself the compute infrastructure', 'ai': None},
 'Lambda': {'cloud': 'GPU cloud provider — is itself the compute infrastructure', 'ai': None},
 'Crusoe': {'cloud': 'Stranded-energy GPU cloud — is itself the compute infrastructure', 'ai': None},
 'Vast.ai': {'cloud': 'GPU compute marketplace — is itself the compute infrastructure', 'ai': None},
 'Vultr': {'cloud': 'Cloud infrastructure provider — is itself the compute infrastructure', 'ai': None},
 'Fluidstack': {'cloud': 'GPU cloud provider — is itself the compute infrastructure', 'ai': None}}

HARDWARE_INDUSTRIES = ['ai chip design', 'biotech manufacturing', 'biotech mfg', 'chip design', 'fusion energy', 'hardware', 'humanoid robotics', 'nuclear energy',
 'nuclear fuel', 'robotics', 'space infrastructure', 'wet lab']

INVESTOR_PRIORS = {'gv': ('GCP', 'Google Ventures portfolio company'),
 'google ventures': ('GCP', 'Google Ventures portfolio company'),
 'google': ('GCP', 'Google-backed company'),
 'gradient ventures': ('GCP', 'Gradient Ventures (Google AI fund) portfolio'),
 'capitalg': ('GCP', 'CapitalG (Google growth fund) portfolio'),
 'm12': ('Azure', 'M12 (Microsoft Ventures) portfolio company'),
 'microsoft': ('Azure', 'Microsoft-backed company'),
 'amazon industrial innovation fund': ('AWS', 'Amazon Industrial Innovation Fund portfolio'),
 'alexa fund': ('AWS', 'Amazon Alexa Fund portfolio'),
 'intel capital': ('AWS', 'Intel Capital portfolio')}

FOUNDER_PRIORS = {'google brain': ('GCP', 'Founded by ex-Google Brain researchers'),
 'deepmind': ('GCP', 'Founded by ex-DeepMind researchers'),
 'google research': ('GCP', 'Founded by ex-Google Research team'),
 'google cloud': ('GCP', 'Founded by ex-Google Cloud team'),
 'google x': ('GCP', 'Founded by ex-Google X team'),
 'google': ('GCP', 'Founded by ex-Google team'),
 'microsoft research': ('Azure', 'Founded by ex-Microsoft Research team'),
 'openai': ('Azure', 'Founded by ex-OpenAI team'),
 'aws': ('AWS', 'Founded by ex-AWS team'),
 'amazon': ('AWS', 'Founded by ex-Amazon team')}

TAXONOMY = {'AI Infrastructure & Compute': {'propensity': 'High',
                                 'sub_verticals': {'Foundational model builders': 'High',
                                                   'AI Hardware Accelerators / Specialized Compute': 'Medium',
                                                   'MLOps / Training platforms': 'High',
                                                   'Vector databases': 'High'}},
 'AI Applications & Tooling': {'propensity': 'High',
                               'sub_verticals': {'AI Development Tools & Agent frameworks': 'High', 'Vertical-specific AI apps': 'High'}},
 'B2B SaaS / Enterprise': {'propensity': 'High',
                           'sub_verticals': {'API-first services': 'High',
                                             'Data-analytics platforms': 'High',
                                             'CRM': 'Medium',
                                             'Collaboration / comms': 'Medium',
                                             'Project-management tools': 'Medium',
                                             'Endpoint security': 'Medium'}},
 'Climate & Energy Tech': {'propensity': 'Medium',
                           'sub_verticals': {'Grid-management software': 'High',
                                             'Carbon-capture process compute': 'High',
                                             'Carbon-accounting SaaS': 'High',
                                             'EV-charging infra SW': 'Medium',
                                             'Precision-agriTech': 'Medium',
                                             'Sustainable-materials R&D': 'Medium',
                                             'Fusion & advanced nuclear': 'Medium',
                                             'Geothermal & subsurface looping': 'Low',
                                             'Utility-scale solar & wind EPC': 'Low',
                                             'Next-gen battery tech & Li supply-chain': 'Low'}},
 'Consumer / E-commerce & Marketplaces': {'propensity': 'High',
                                          'sub_verticals': {'Travel / leisure marketplaces': 'High',
                                                            'E-commerce enablers': 'High',
                                                            'Social media & consumer apps': 'High',
                                                            'Streaming & Immersive Media': 'High',
                                                            'Connected Consumer Hardware & IoT': 'Medium',
                                                            'DTC infra-platforms': 'Medium'}},
 'Cybersecurity': {'propensity': 'High',
                   'sub_verticals': {'Data-security / privacy / vaulting': 'High',
                                     'CSPM / CNAPP': 'High',
                                     'Threat Detection & Response / SIEM': 'High',
                                     'IAM & auth': 'High',
                                     'Endpoint security': 'Medium'}},
 'Data Infrastructure': {'propensity': 'High',
                         'sub_verticals': {'Data pipelines & ETL': 'High',
                                           'Lakehouse & data warehouse': 'High',
                                           'Reverse ETL & data activation': 'High',
                                           'Data quality & observability': 'High'}},
 'Developer Tools': {'propensity': 'High',
                     'sub_verticals': {'CI/CD & DevOps platforms': 'High',
                                       'Observability & monitoring': 'High',
                                       'API management & gateways': 'High',
                                       'Security tooling for developers': 'High'}},
 'Education Tech': {'propensity': 'Medium',
                    'sub_verticals': {'AI tutoring & adaptive learning': 'High',
                                      'Learning management platforms': 'Medium',
                                      'Credentialing & skills platforms': 'Medium'}},
 'Fintech, Payments and Crypto': {'propensity': 'High',
                                  'sub_verticals': {'LendingTech': 'High',
                                                    'Investment Tech': 'High',
                                                    'Digital Banking / Neobanks': 'High',
                                                    'Payment Processing': 'High',
                                                    'RegTech & compliance': 'High',
                                                    'InsurTech': 'High',
                                                    'Crypto / Web3 infra': 'Low',
                                                    'DeFi': 'Low'}},
 'Healthcare, BioTech & Life Sciences': {'propensity': 'High',
                                         'sub_verticals': {'AI drug discovery': 'High',
                                                           'Health-data analytics': 'High',
                                                           'Genomics & bioinformatics': 'High',
                                                           'Medical-device IoT platforms': 'High',
                                                           'Tele-health platforms': 'High',
                                                           'Digital therapeutics (DTx)': 'Medium',
                                                           'Cell & gene therapy manufacturing': 'Medium',
                                                           'Bio-foundries & wet-lab platforms': 'Medium',
                                                           'Oncology & cancer immunotherapy': 'Medium'}},
 'HR Tech / Workforce Tech': {'propensity': 'High',
                              'sub_verticals': {'Recruiting & talent intelligence': 'High',
                                                'Workforce analytics': 'High',
                                                'Skills & learning platforms': 'Medium',
                                                'Payroll & benefits platforms': 'Medium'}},
 'Industrial / IoT / Robotics': {'propensity': 'High',
                                 'sub_verticals': {'Robotics control platforms': 'Medium',
                                                   'Warehouse / logistics platforms': 'High',
                                                   'Industrial IoT platforms': 'High',
                                                   'Process-optimisation SW': 'High',
                                                   'Digital twins': 'High',
                                                   'Predictive maintenance': 'High'}},
 'Legal Tech': {'propensity': 'High',
                'sub_verticals': {'Contract analysis & management': 'High',
                                  'E-discovery & litigation support': 'High',
                                  'Regulatory compliance automation': 'High'}},
 'Aero / Defence / Space': {'propensity': 'Medium',
                            'sub_verticals': {'Sat-image analytics': 'High',
                                              'Autonomous systems': 'Medium',
                                              'Mobility & Transportation Tech': 'Medium',
                                              'Launch-systems software': 'Low'}},
 'PropTech / Real Estate Tech': {'propensity': 'Medium',
                                 'sub_verticals': {'Property data & valuation platforms': 'High',
                                                   'Smart building & IoT platforms': 'Medium',
                                                   'Real estate transaction platforms': 'Medium'}},
 'Construction Tech / AEC': {'propensity': 'High',
                             'sub_verticals': {'AI project management & scheduling': 'High',
                                               'BIM & digital design platforms': 'High',
                                               'Safety monitoring & site IoT': 'Medium'}}}

ARTICLE_SKIP_DOMAINS = ['a16z.com', 'accel.com', 'accesswire.com', 'adweek.com', 'apnews.com', 'arstechnica.com', 'axios.com', 'bbc.co.uk', 'bbc.com', 'bing.com',
 'bloomberg.com', 'businessinsider.com', 'businesswire.com', 'citybiz.co', 'cnbc.com', 'cookielaw.org', 'crunchbase.com', 'dealroom.co',
 'docs.google.com', 'economist.com', 'engadget.com', 'facebook.com', 'fastcompany.com', 'finsmes.com', 'forbes.com', 'fortune.com', 'ft.com',
 'globenewswire.com', 'google.com', 'greylock.com', 'inc.com', 'instagram.com', 'kleinerperkins.com', 'lightspeedvp.com', 'linkedin.com',
 'medium.com', 'newsweek.com', 'notion.so', 'nytimes.com', 'onetrust.com', 'pitchbook.com', 'prnewswire.com', 'prweb.com', 'reuters.com',
 'sequoiacap.com', 'siliconangle.com', 'substack.com', 'techcrunch.com', 'theatlantic.com', 'theguardian.com', 'theverge.com', 'tiktok.com',
 'time.com', 'tracxn.com', 'twitter.com', 'venturebeat.com', 'washingtonpost.com', 'wired.com', 'wsj.com', 'x.com', 'yahoo.com', 'youtube.com']

STARTUP_PREFIXES = ('try', 'get', 'use', 'go', 'meet', 'join', 'run', 'with')

MULTI_PART_TLDS = ['co.in', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.mx', 'gov.uk', 'net.uk', 'org.uk']

LEADERSHIP_TITLES = ['cto', 'chief technology officer', 'vp engineering', 'vp of engineering', 'vice president engineering', 'vp infrastructure', 'vp of infrastructure',
 'head of infrastructure', 'head of platform', 'head of cloud', 'head of engineering', 'head of devops', 'head of sre']

CTO_TITLES = ['chief technology officer', 'cto']

PRESS_DOMAINS = ['arstechnica.com', 'bloomberg.com', 'cnbc.com', 'forbes.com', 'infoworld.com', 'reuters.com', 'siliconangle.com', 'techcrunch.com', 'thenewstack.io',
 'theverge.com', 'venturebeat.com', 'wired.com', 'zdnet.com']

VENDORS = ['Snowflake', 'Databricks', 'Datadog', 'HashiCorp', 'Terraform', 'Confluent', 'MongoDB', 'Elastic', 'Redis', 'CockroachDB', 'Stripe', 'Twilio',
 'Cloudflare', 'Fastly', 'Akamai', 'PagerDuty', 'Splunk', 'New Relic', 'Grafana', 'Docker', 'Kubernetes', 'Pulumi', 'Vercel', 'Netlify', 'Supabase',
 'PlanetScale', 'Neon']

CNAME_PROVIDERS = {
    "amazonaws.com": "AWS", "cloudfront.net": "AWS", "elb.amazonaws.com": "AWS", "googleusercontent.com": "GCP", "ghs.googlehosted.com": "GCP",
    "c.storage.googleapis.com": "GCP", "run.app": "GCP", "azurewebsites.net": "Azure", "azure.com": "Azure", "azureedge.net": "Azure",
    "trafficmanager.net": "Azure",
}

HEADER_PROVIDERS = {
    "AWS": ["x-amz-cf-id", "x-amz-request-id", "x-amz-cf-pop"], "GCP": ["x-cloud-trace-context", "x-goog-generation"], "Azure": ["x-azure-ref", "x-ms-request-id"],
}

REJECTED_SITES = ["linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "crunchbase.com", "pitchbook.com"]

REJECTED_DOMAINS = REJECTED_SITES + [
    "medium.com", "substack.com", "youtube.com", "hugedomains.com", "sedo.com", "dan.com", "afternic.com", "godaddy.com", "namecheap.com",
    "undeveloped.com", "brandbucket.com", "squadhelp.com", "github.io", "vercel.app", "netlify.app", "pages.dev", "surge.sh", "herokuapp.com",
    "glitch.me", "replit.dev", "webflow.io", "framer.app",
]

ROUNDS = {
    "SEED": "Seed", "PRE-SEED": "Pre-Seed", "SERIES A": "Series A", "SERIES B": "Series B", "SERIES C": "Series C", "SERIES D": "Series D", "SERIES E": "Series E",
}

NEWS_FUNDING_WORDS = ["raises", "raised", "funding", "million", "series", "seed", "secures", "closes", "backed", "led by"]

WIRE_FUNDING_WORDS = [
    "raises", "raised", "funding", "series a", "series b", "series c", "seed round", "venture", "million", "investment round", "closes", "secures", "led by",
]

WIRE_SKIP_WORDS = ["real estate", "mortgage", "loan", "ipo", "acquisition", "merger", "presale", "token", "ico"]

SOURCE_PRIORITY = {"vcnewsdaily": 4, "prnewswire": 3, "google_news": 1}

BAD_REDIRECTS = [
    "sedo.", "dan.com", "afternic.", "godaddy.", "namecheap.", "hoojacont.", "imagegenerators.", "twitch.tv", ".ooe.gv.at",
]

SHORT_PAGE_REDIRECTS = ["window.location.replace(", "window.location.href="]

PARKING_SNIPPETS = ['window.location.href="/lander"', "sedo.com", "godaddy.com/domain", "this domain is for sale", "domain is registered", "buy this domain"]

OWNED_SOURCES = ["dns", "ip_asn", "job_posting", "subprocessors"]

MARKETPLACE_PATTERNS = {
    "AWS": ["aws.amazon.com/marketplace/pp/", "aws.amazon.com/marketplace/seller-profile"],
    "Azure": [
        "azuremarketplace.microsoft.com/marketplace/apps/", "azuremarketplace.microsoft.com/en-us/marketplace/apps/", "appsource.microsoft.com/product/",
    ],
    "GCP": ["cloud.google.com/marketplace/product/", "console.cloud.google.com/marketplace/"],
}

# Site paths by signal source and weight, in order.
PATH_GROUPS = {
    **dict.fromkeys(["/integrations", "/partners", "/ecosystem", "/marketplace"], ("integrations_page", 0.6)),
    **dict.fromkeys(["/docs", "/developers", "/api", "/documentation"], ("tech_docs", 0.6)),
    **dict.fromkeys(
        [
            "/security", "/trust", "/privacy", "/compliance", "/legal/privacy", "/legal/security", "/trust-center", "/privacy-policy", "/legal/privacy-policy",
            "/data-processing", "/dpa",
        ], ("trust_page", 0.6),
    ),
    **dict.fromkeys(["/blog", "/eng/blog", "/engineering", "/tech-blog"], ("tech_blog", 0.3)),
    "/": ("homepage", 0.3),
}
